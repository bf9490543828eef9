"""The offline job: order lines in, published relationship snapshot out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wicker.operators import basket as B
from wicker.operators import normalise as N
from wicker.operators import validate as C
from wicker.operators.reliability import with_reliability
from wicker.params import NormaliseParams, PairParams, ValidationParams
from wicker.session import stage_table
from wicker.sources import orders as O
from wicker.sources import store


class BuildError(RuntimeError):
    """The job produced nothing to publish; the active snapshot stays."""


@dataclass(frozen=True)
class BuildConfig:
    root: str
    window_from: str
    accepted_states: tuple[str, ...]
    window_to: str | None = None
    excluded_products: tuple[str, ...] = ()
    tie_break: tuple[str, ...] = ()
    max_products: int = 50
    pairs: PairParams = field(default_factory=PairParams)
    min_reliability: float = 0.3
    model_version: str = "same-order-v1"


def to_records(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tagged source lines to raw records: one header per accepted order, and its lines."""
    headers = O.transaction_headers(tagged).select(
        F.col("transaction_id").alias("seq"),
        "transaction_id",
        "transaction_type",
        F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("occurred_at"),
        "status",
        F.lit(None).cast("string").alias("customer_key"),
        F.lit(True).alias("has_lines"),
        "source_system",
        "source_reference",
    )
    lines = O.clean_lines(tagged).select(
        F.col("order_id").alias("seq"),
        F.col("line_id").alias("line_seq"),
        F.col("line_id").cast("string").alias("line_id"),
        "product_id",
        F.lit(None).cast("string").alias("combination_id"),
        "quantity",
        F.lit(None).cast("string").alias("line_status"),
    )
    return headers, lines


def build_snapshot(orders: DataFrame, lines: DataFrame, cfg: BuildConfig) -> dict:
    """Run all stages and publish; returns the summary.

    What several stages read is stored in between: baskets, pair counts and
    candidate edges. The driver sees counters only.
    """
    tagged = O.tag_lines(
        O.order_lines(orders, lines, cfg.window_from, cfg.window_to),
        cfg.accepted_states,
        cfg.excluded_products,
        cfg.tie_break,
    )
    # headers, lines and counters read this: the source itself is read once
    tagged = stage_table(tagged, "tagged")
    headers, raw = to_records(tagged)
    params = NormaliseParams(
        cfg.accepted_states,
        max_products=cfg.max_products,
        window_from=cfg.window_from,
        window_to=cfg.window_to,
    )
    normal = N.normalise(headers, raw, params)
    # the normaliser has bounded the baskets, so each fits into one row
    arrays = (
        normal.items.withColumn("item", B.pack())
        .groupBy("transaction_id")
        .agg(F.sort_array(F.collect_list("item")).alias("items"), F.max("occurred_at").alias("occurred_at"))
    )
    stored = stage_table(arrays, "baskets")
    source = O.read_stats(tagged).first().asDict()
    records = normal.headers.agg(
        F.count_if(F.col("reject_code").isNull()).alias("accepted"),
        F.count_if(F.col("reject_code").isNotNull()).alias("rejected"),
    ).first()
    facts = stored.agg(F.date_format(F.max("occurred_at"), "yyyy-MM-dd HH:mm:ss.SSS").alias("latest")).first()
    products = stored.select(F.explode("items").alias("item")).distinct().count()
    window = (cfg.window_from, cfg.window_to or facts["latest"] or cfg.window_from)

    baskets = B.Baskets(stored, None)
    pairs = stage_table(B.unordered_pair_counts(baskets), "pairs")
    candidates = B.same_order_candidates(baskets, cfg.pairs, pairs)
    edges = C.complete_edges(with_reliability(B.as_relationships(candidates, window, cfg.model_version)))
    staged = stage_table(edges.select(*C.EDGE), "candidates")
    # candidates are unique by construction: any order of repeats will do
    checked = C.validate(
        staged.withColumn("seq", F.lit(0)), ValidationParams(min_reliability=cfg.min_reliability)
    )
    counts = checked.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("reject_code").isNull()).alias("valid")
    ).first()
    if counts["valid"] == 0:
        raise BuildError("no valid relationships were produced; the active snapshot was not changed")
    published = store.publish(C.accepted(checked).drop("seq"), cfg.root, model_version=cfg.model_version)
    return {
        "source_orders_read": source["source_orders_read"],
        "source_lines_read": source["source_lines_read"],
        "orders_accepted": records["accepted"],
        "orders_excluded": records["rejected"] + source["source_orders_excluded"],
        "distinct_products": products,
        "pair_candidates": 2 * pairs.count(),
        "reliable_candidates": counts["n"],
        "valid_relationships": counts["valid"],
        "rejected_relationships": counts["n"] - counts["valid"],
        "snapshot_id": published["snapshot_id"],
        "window_to": window[1],
        "distinct_source_products": published["distinct_source_products"],
    }
