"""Queries over the test tables and the jobs built from the operators."""

import importlib

_MODULES = ["q_basket", "q_orders", "q_edges", "q_catalog", "q_reco", "q_compose", "q_search", "q_history"]


def load_all() -> None:
    for name in _MODULES:
        importlib.import_module(f"wicker.plans.{name}")
