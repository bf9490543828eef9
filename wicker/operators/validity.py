"""What is valid at an instant: a join of many instants with many intervals.

Intervals are half open: from (included, NULL = always) to (not included, NULL = for
ever). Each interval is filed on the level whose buckets are at least as wide as the
interval is long, so it touches at most two buckets there, and one that covers all
time has a level with a single bucket. An instant looks into one bucket of each level
that occurs, at most LEVELS of them. The join is by equality on keys, level and
bucket, and the exact test of the ends is left to the rows that meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wicker.functions.ranking import top_1

BASE_SECONDS = 3600  # buckets of the lowest level
LEVELS = 40  # the highest is for intervals with an open end


def _seconds(c: str) -> Column:
    return F.unix_micros(c) / F.lit(1_000_000.0)


def _bucket(seconds: Column, level: Column) -> Column:
    return F.when(level == LEVELS, F.lit(0).cast("long")).otherwise(F.floor(seconds / (F.lit(float(BASE_SECONDS)) * F.pow(F.lit(2.0), level))))


def filed(intervals: DataFrame, start: str, end: str) -> DataFrame:
    """Adds level and bucket, one row for each bucket that an interval touches; empty intervals go."""
    length = (_seconds(end) - _seconds(start)) / BASE_SECONDS
    level = F.when(F.col(start).isNull() | F.col(end).isNull(), LEVELS).otherwise(F.least(F.lit(LEVELS - 1), F.ceil(F.log2(F.greatest(length, F.lit(1.0)))).cast("int")))
    some = F.col(start).isNull() | F.col(end).isNull() | (F.col(start) < F.col(end))
    rows = intervals.filter(some).withColumn("level", level.cast("int"))
    first, last = (F.coalesce(_bucket(_seconds(c), F.col("level")), F.lit(0).cast("long")) for c in (start, end))
    return rows.withColumn("bucket", F.explode(F.sequence(first, last)))


def valid_at(instants: DataFrame, intervals: DataFrame, keys: list[str], at: str = "at", start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Every instant with every interval of its keys that holds it, once; rows with a NULL key or instant meet nothing."""
    index = filed(intervals, start, end)
    levels = sorted(r["level"] for r in index.select("level").distinct().collect())  # at most LEVELS + 1 numbers
    level = F.explode(F.array(*[F.lit(n) for n in levels]) if levels else F.array().cast("array<int>"))
    asked = instants.filter(F.col(at).isNotNull()).withColumn("level", level).withColumn("bucket", _bucket(_seconds(at), F.col("level")))
    met = asked.join(index, [*keys, "level", "bucket"])
    inside = (F.col(start).isNull() | (F.col(start) <= F.col(at))) & (F.col(end).isNull() | (F.col(at) < F.col(end)))
    return met.filter(inside).drop("level", "bucket")


def rule_edges(rules: DataFrame, instants: DataFrame) -> DataFrame:
    """The rule that holds for each request, source and target: of several, the latest version, then the least rule_id.

    `rules`: rule_id, rule_version, source_product_id, target_product_id, reliability,
    valid_from, valid_to. `instants`: request_id, source_product_id, at. Rules
    from a product to itself, without an id or without a target are left out.
    """
    usable = F.col("rule_id").isNotNull() & (F.col("source_product_id") != F.col("target_product_id"))
    met = valid_at(instants, rules.filter(usable), ["source_product_id"])
    order = [F.col("rule_version").desc(), F.col("rule_id").asc()]
    chosen = top_1(met, ["request_id", "source_product_id", "target_product_id"], order)
    return chosen.withColumn("relationship_type", F.lit("manual")).withColumn("evidence_kind", F.lit("rule"))
