"""Order lines as the source of transactions.

`orders`: order_id, occurred_at, order_state. `lines`: order_id, line_id,
product_id, quantity and any columns that fix the input order of repeats.
Transactions stay in two flat tables, headers and lines, keyed by the order:
an order of any size never has to fit into one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wicker.functions.cascade import first_match
from wicker.functions.keys import beside, blank


def order_lines(
    orders: DataFrame, lines: DataFrame, from_: str, to: str | None = None
) -> DataFrame:
    """Lines of orders inside the inclusive date range."""
    at = F.col("occurred_at")
    inside = at >= F.lit(from_).cast("timestamp")
    if to is not None:
        inside = inside & (at <= F.lit(to).cast("timestamp"))
    return orders.filter(inside).join(lines, "order_id")


def positive_integer(quantity: str) -> Column:
    q = F.col(quantity).cast("double")
    return q.isNotNull() & ~F.isnan(q) & (q > 0) & (q == F.floor(q))


def tag_lines(
    df: DataFrame,
    accepted_states: Sequence[str],
    excluded_products: Sequence[str] = (),
    tie_break: Sequence[str] = (),
    states_vary: bool = False,
) -> DataFrame:
    """Adds drop_reason (NULL = kept), order_accepted and copies to every line.

    Equal copies of a line are one row with their number in `copies`; of an
    accepted order, all but one of them count as duplicates.

    With `states_vary` an order may carry several states and its first line
    decides; a scan of an order table has one state per order and skips that.
    """
    seq = ["occurred_at", "order_id", "line_id", *tie_break]
    complete = F.col("order_id").isNotNull() & F.col("order_state").isNotNull() & F.col("line_id").isNotNull()
    if states_vary:
        states = (
            df.filter(complete)
            .groupBy("order_id")
            .agg(F.min_by("order_state", F.struct(*seq)).alias("__state"))
        )
        df = df.join(states, "order_id", "left").withColumn(
            "order_state", F.coalesce("__state", "order_state")
        ).drop("__state")
    accepted = F.col("order_state").isin(list(accepted_states))
    df = df.withColumn("order_accepted", F.when(complete, accepted))
    df = _fold_copies(df, ["order_id", "line_id"], seq)
    reason = first_match(
        [
            (~complete, "INCOMPLETE"),
            (~F.col("order_accepted"), "ORDER_EXCLUDED"),
            (F.col("__repeat"), "DUPLICATE_LINE"),
            (blank("product_id") | ~positive_integer("quantity"), "INVALID_LINE"),
            (F.trim("product_id").isin(list(excluded_products)), "PRODUCT_EXCLUDED"),
        ]
    )
    return df.withColumn("drop_reason", reason).drop("__repeat")


def _fold_copies(df: DataFrame, keys: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """Folds equal lines into one with their number in `copies`, and marks later lines of a key in `__repeat`.

    Copies meet on the map side first, so a line with very many of them stays one
    row; the first line of a key is then found among distinct lines. Only lines of
    accepted orders are marked.
    """
    place = F.struct(*seq, F.xxhash64(*[c for c in df.columns if c not in seq]))
    folded = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("copies")).withColumn("__place", place)
    first = (
        folded.filter("order_accepted")
        .groupBy(*keys)
        .agg(F.min("__place").alias("__first"), F.count(F.lit(1)).alias("__n"))
        .filter(F.col("__n") > 1)
        .drop("__n")
    )
    later = F.coalesce(F.col("order_accepted") & (F.col("__place") > F.col("__first")), F.lit(False))
    return folded.join(first, list(keys), "left").withColumn("__repeat", later).drop("__place", "__first")


def clean_lines(tagged: DataFrame) -> DataFrame:
    return tagged.filter(F.col("drop_reason").isNull()).drop("drop_reason", "order_accepted", "copies")


def read_stats(tagged: DataFrame) -> DataFrame:
    """Counters of one source read, one row.

    Orders are counted on one row per order, so the distinct count carries no
    line data.
    """
    reason, copies = F.col("drop_reason"), F.col("copies")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("bigint"))
    lines = tagged.agg(
        total(copies).alias("source_lines_read"),
        total(F.when(reason.isNotNull(), copies).otherwise(copies - 1)).alias("source_lines_excluded"),
        total(
            F.when(reason == "DUPLICATE_LINE", copies).when(F.col("order_accepted"), copies - 1)
        ).alias("source_duplicate_lines_excluded"),
        F.count_if(reason == "PRODUCT_EXCLUDED").alias("source_products_excluded"),
    )
    orders = (
        tagged.filter(F.col("order_accepted").isNotNull())
        .groupBy("order_id")
        .agg(F.max("order_accepted").alias("accepted"))
        .agg(
            F.count(F.lit(1)).alias("source_orders_read"),
            F.count_if(~F.col("accepted")).alias("source_orders_excluded"),
        )
    )
    return beside(orders, lines)


def transaction_headers(tagged: DataFrame) -> DataFrame:
    """One record per accepted order, also where every line was dropped."""
    kept = F.col("drop_reason").isNull()
    return (
        tagged.filter(F.col("order_accepted"))
        .groupBy("order_id")
        .agg(
            F.min("occurred_at").alias("occurred_at"),
            F.min("order_state").alias("status"),
            F.count_if(kept).alias("line_count"),
            F.coalesce(F.sum(F.when(kept, F.col("quantity"))), F.lit(0.0)).alias("total_quantity"),
        )
        .select(
            F.col("order_id").alias("transaction_id"),
            F.lit("order").alias("transaction_type"),
            "occurred_at",
            "status",
            "line_count",
            "total_quantity",
            F.lit("shop").alias("source_system"),
            F.concat(F.lit("order:"), "order_id").alias("source_reference"),
        )
    )
