"""Ordered rules: the first one that holds names the outcome."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_match(rules: Sequence[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """Code of the first rule whose condition is true (NULL counts as false)."""
    result: Column | None = None
    for condition, code in rules:
        result = F.when(condition, F.lit(code)) if result is None else result.when(condition, F.lit(code))
    assert result is not None, "at least one rule is needed"
    return result.otherwise(F.lit(otherwise))


def codes(rules: Sequence[tuple[Column, str]]) -> Column:
    """Array of the codes of all rules that hold, in the order given."""
    return F.array_compact(F.array(*[F.when(condition, F.lit(code)) for condition, code in rules]))


def with_code(df: DataFrame, name: str, rules: Sequence[tuple[Column, str]] | Column) -> DataFrame:
    """Adds the cascade as a column that is evaluated once per row.

    A plain projected column is copied into every later filter on it; a long
    cascade then no longer fits into generated code. The one-element explode
    keeps it in place.
    """
    code = rules if isinstance(rules, Column) else first_match(rules)
    return df.withColumn(name, F.explode(F.array(code)))
