"""Top-k and keep-first, both safe when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wicker.functions.keys import join_on


def top_k(
    df: DataFrame,
    partition: Sequence[str | Column],
    order: Sequence[Column],
    k: int,
    rank: str = "rank",
) -> DataFrame:
    """First k rows per group.

    The filter sits directly on the row number, so Spark cuts every group to k
    rows on the map side (WindowGroupLimit) and a hot group stays small.
    """
    window = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def top_1(
    df: DataFrame, partition: Sequence[str | Column], order: Sequence[Column]
) -> DataFrame:
    return top_k(df, partition, order, 1, "__first").drop("__first")


def mark_repeats(
    df: DataFrame,
    keys: Sequence[str],
    seq: Sequence[str],
    flag: str,
    among: Column | None = None,
    holders: Column | None = None,
) -> DataFrame:
    """Flag rows that come after the first row of their key in `seq` order.

    `seq` must not repeat within a key.

    The first row comes from a `min` aggregate with a map-side part, and only
    keys that occur twice reach the join, so a key with very many copies is
    never sorted in one task. Rows outside `among` take no part and are never
    flagged; only rows that satisfy `holders` can be the first of a key.
    """
    part = df if among is None else df.filter(among)
    place = F.struct(*seq)
    if holders is not None:
        place = F.when(holders, place)
    first = (
        part.groupBy(*keys)
        .agg(F.min(place).alias("__first"), F.count(F.lit(1)).alias("__n"))
        .filter((F.col("__n") > 1) & F.col("__first").isNotNull())
        .select(*keys, "__first")
    )
    joined = join_on(df, first, list(keys), "left")
    later = F.col("__first").isNotNull() & (F.struct(*seq) > F.col("__first"))
    if among is not None:
        later = later & F.coalesce(among, F.lit(False))
    return joined.withColumn(flag, F.coalesce(later, F.lit(False))).drop("__first")
