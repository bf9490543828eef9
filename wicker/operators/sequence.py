"""What customers buy next, and what changed between two snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wicker.functions.keys import join_on, pack, unpack
from wicker.operators.basket import dealt_tails
from wicker.operators.validate import EDGE, IDENTITY
from wicker.session import stage_table


RANGE_DAYS = 30
# products of baskets for each task that counts pairs
ROWS = 50_000


def successors(baskets: DataFrame) -> DataFrame:
    """(transaction_id, next_id, lag_days) of consecutive baskets (customer_key, transaction_id, at) of one customer.

    A customer's baskets are sorted in ranges of RANGE_DAYS; the last of a range is
    followed by the first of the customer's next range. What is sorted together is
    one range, or one row for each range of a customer.
    """
    ranged = baskets.withColumn("range", F.floor(F.date_diff("at", F.lit("1970-01-01").cast("date")) / F.lit(RANGE_DAYS)))
    inside = Window.partitionBy("customer_key", "range").orderBy("at", "transaction_id")
    after = F.lead(F.struct("at", "transaction_id"))
    placed = ranged.withColumn("next", after.over(inside))
    heads = ranged.groupBy("customer_key", "range").agg(F.min(F.struct("at", "transaction_id")).alias("head"))
    heads = heads.withColumn("next_head", F.lead("head").over(Window.partitionBy("customer_key").orderBy("range")))
    rest = placed.filter(F.col("next").isNull()).join(heads, ["customer_key", "range"])
    both = placed.filter(F.col("next").isNotNull()).select("transaction_id", "at", "next").unionByName(rest.select("transaction_id", "at", F.col("next_head").alias("next")))
    return both.filter(F.col("next").isNotNull()).select(
        "transaction_id", F.col("next.transaction_id").alias("next_id"), F.date_diff(F.col("next.at"), F.col("at")).alias("lag_days")
    )


def medians(steps: DataFrame) -> DataFrame:
    """(source, target, transition_count, median_lag_days) of steps (a, share, b, lag_days), dealt as by `dealt_tails`.

    Up to three lags, or equal ones, have their median in count, sum, least and largest,
    which are plain numbers. The other pairs meet their steps again; without any, that is
    not planned.
    """
    lag = F.col("lag_days").cast("bigint")
    key = ["a", "share", "b"]
    found = steps.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum(lag).alias("sum"), F.min(lag).alias("least"), F.max(lag).alias("most"))
    found = stage_table(found, "transitions")
    n, least, most = F.col("n"), F.col("least"), F.col("most")
    many = (n > 3) & (least < most)
    middle = F.when(n == 3, F.col("sum") - least - most).otherwise((least + most) / 2).cast("double")
    ends = [F.col("a").alias("source"), F.col("b").alias("target"), F.col("n").alias("transition_count")]
    plain = found.filter(~many).select(*ends, middle.alias("median_lag_days"))
    rest = found.filter(many).select(*key, "n")
    if rest.isEmpty():
        return plain
    again = join_on(steps, rest.drop("n"), key, "left_semi").groupBy(*key)
    whole = again.agg(F.count(F.lit(1)).alias("n"), F.median("lag_days").alias("median_lag_days"))
    return plain.unionByName(whole.select(*ends, "median_lag_days"))


def next_purchases(items: DataFrame) -> DataFrame:
    """Directed product pairs of consecutive baskets of one customer.

    Columns: source and target product, transition_count, source_count (baskets
    with the source that have a successor), transition_probability and
    median_lag_days. Baskets of a customer are ordered by time, then id; only ids
    and times go through that order, a month of a customer at a time. A product travels
    with the list of the next basket, and pairs are counted where the lists of a product
    meet. Pairs grow with the product of two basket sizes, which the normaliser bounds.
    Rows without a customer take no part.
    """
    known = items.filter(F.col("customer_key").isNotNull())
    baskets = known.groupBy("customer_key", "transaction_id").agg(F.min("occurred_at").alias("at"))
    named = known.filter(F.col("transaction_id").isNotNull())
    # a struct, as a set of plain ids would leave a product without an id out
    held = F.transform(F.collect_set(F.struct(pack().alias("item"))), lambda s: s["item"])
    contents = stage_table(named.groupBy("transaction_id").agg(held.alias("items")), "contents")
    steps = successors(baskets).join(contents, "transaction_id").select("next_id", "lag_days", "items")
    steps = stage_table(steps, "steps")
    totals = steps.select(F.explode("items").alias("source")).filter(F.col("source").isNotNull()).groupBy("source").agg(F.count(F.lit(1)).alias("source_count"))
    following = contents.select(F.col("transaction_id").alias("next_id"), F.col("items").alias("partners"))
    tails = steps.join(following, "next_id").select(F.explode("items").alias("a"), "partners", "lag_days").filter(F.col("a").isNotNull())
    rows = steps.agg(F.coalesce(F.sum(F.size("items")), F.lit(0)).alias("n")).first()["n"]
    tasks = max(items.sparkSession.sparkContext.defaultParallelism, rows // ROWS + 1)
    pairs = medians(dealt_tails(tails, totals.withColumnsRenamed({"source": "item", "source_count": "n"}), tasks))
    return pairs.join(totals, "source").select(
        *unpack("source", "source_"),
        *unpack("target", "target_"),
        "transition_count",
        "source_count",
        (F.col("transition_count") / F.col("source_count")).alias("transition_probability"),
        "median_lag_days",
    )


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges that only one of two snapshots has, by identity: `change` is appeared or vanished."""

    def only(left: DataFrame, right: DataFrame, change: str) -> DataFrame:
        keys = right.select(*[F.col(c).alias(f"__{c}") for c in IDENTITY])
        same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in IDENTITY]
        condition = same[0]
        for s in same[1:]:
            condition = condition & s
        return left.select(*EDGE).join(keys, condition, "left_anti").withColumn("change", F.lit(change))

    return only(new, old, "appeared").unionByName(only(old, new, "vanished"))
