"""Pairs of products in the history of one customer, whatever the basket.

A history has no upper size. Its products are dealt to blocks by hash, and each
pair of blocks of one customer is a group of bounded size, so no task holds a
long history and each pair comes out once. Pairs travel as a product with the list of
its later partners, not as rows of their own, and are counted where the lists of a
product meet; a product of very many customers is dealt by partner. The state is kept
in tables; new lines are counted against it without counting the old pairs again.

Pairs grow with the square of a history, so they are counted in parts: those whose first
product falls into one part, then the next. A part's shuffle files and what it stored on
its way go before the next begins, so that disk holds one part however many pairs there are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wicker.functions.keys import pack
from wicker.operators.basket import HOT, dealt_tails, metrics, mirror
from wicker.session import drop_folders, folders_made, stage_and_clear

BLOCK = 64
# distinct (customer, product) rows for each task that counts pairs
ROWS = 50_000
# pairs of single customers for each part
PART = 250_000_000


@dataclass(frozen=True)
class History:
    """State of all customers.

    contents: distinct (customer_key, item). counts: (item, customers). total: one row with
    the number of customers. counted: the lists of one part of several, (a, partners, n): the
    products behind `a` that n customers hold together with it. lists: those of all parts,
    where they are stored.
    """

    contents: DataFrame
    counts: DataFrame
    total: DataFrame
    counted: Callable[[int, int], DataFrame]
    lists: DataFrame | None = None

    def lists_of(self, part: int, parts: int) -> DataFrame:
        return self.counted(part, parts) if self.lists is None else self.lists.filter(_in_part(F.col("a"), part, parts))

    @property
    def pairs(self) -> DataFrame:
        """(a, b, joint_count), a before b."""
        return _pairs(self.lists_of(0, 1))


def contents_of(items: DataFrame) -> DataFrame:
    """Distinct products of each customer; rows without a customer or a product take no part."""
    item = pack()
    return items.filter(F.col("customer_key").isNotNull() & item.isNotNull()).select("customer_key", item.alias("item")).distinct()


def _in_blocks(contents: DataFrame, block: int, prefix: str) -> tuple[DataFrame, DataFrame]:
    """Blocks by customer, and the products with their block."""
    blocks = contents.groupBy("customer_key").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias(f"{prefix}blocks"))
    dealt = contents.join(blocks, "customer_key")
    return blocks, dealt.withColumn("own", F.pmod(F.xxhash64("item"), F.col(f"{prefix}blocks")).cast("int"))


def _groups(rows: DataFrame, within: bool) -> DataFrame:
    """(same, low, high) from rows (customer_key, i, j, item, is_low). With `within`, a block meets itself where i = j and is `low` alone."""
    # one struct key, so that the block pairs of one customer spread over the tasks
    return (
        rows.groupBy(F.struct("customer_key", "i", "j").alias("group"))
        .agg(F.collect_list(F.when(F.col("is_low"), F.col("item"))).alias("low"), F.collect_list(F.when(~F.col("is_low"), F.col("item"))).alias("high"))
        .select((F.col("group.i") == F.col("group.j") if within else F.lit(False)).alias("same"), "low", "high")
    )


def _in_part(item: Column, part: int, parts: int) -> Column:
    return F.pmod(F.xxhash64(item), F.lit(parts)) == part if parts > 1 else F.lit(True)


def _tails(groups: DataFrame, part: int = 0, parts: int = 1) -> DataFrame:
    """(a, partners): each product of a group, if in the part, with those it meets there that sort behind it."""
    first = lambda own: F.filter(own, lambda x: _in_part(x, part, parts)) if parts > 1 else own
    after = lambda own, others: F.transform(first(own), lambda x: F.struct(x.alias("a"), F.filter(others, lambda y: y > x).alias("partners")))
    both = F.when(F.col("same"), after(F.col("low"), F.col("low"))).otherwise(F.concat(after(F.col("low"), F.col("high")), after(F.col("high"), F.col("low"))))
    return groups.select(F.explode(both).alias("p")).select("p.*").filter(F.size("partners") > 0)


def _each(tails: DataFrame) -> DataFrame:
    return tails.select("a", F.explode("partners").alias("b"))


def _groups_within(contents: DataFrame, block: int) -> DataFrame:
    _, dealt = _in_blocks(contents, block, "")
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    return _groups(spread.select("customer_key", i.alias("i"), j.alias("j"), "item", (F.col("own") == i).alias("is_low")), True)


def _within(contents: DataFrame, block: int) -> DataFrame:
    return _tails(_groups_within(contents, block))


def pairs_within(contents: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row (a, b) per customer and unordered pair of its products."""
    return _each(_within(contents, block))


def _groups_between(new: DataFrame, old: DataFrame, block: int) -> DataFrame:
    new_blocks, new_rows = _in_blocks(new, block, "new_")
    old_blocks, old_rows = _in_blocks(old, block, "old_")
    left = new_rows.join(old_blocks, "customer_key").select(
        "customer_key",
        F.col("own").alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("old_blocks") - 1)).alias("j"),
        "item",
        F.lit(True).alias("is_low"),
    )
    right = old_rows.join(new_blocks, "customer_key").select(
        "customer_key",
        F.explode(F.sequence(F.lit(0), F.col("new_blocks") - 1)).alias("i"),
        F.col("own").alias("j"),
        "item",
        F.lit(False).alias("is_low"),
    )
    return _groups(left.unionByName(right), False)


def pairs_between(new: DataFrame, old: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row (a, b) per customer, product of `new` and product of `old`; the two share no product of a customer."""
    return _each(_tails(_groups_between(new, old, block)))


def _counted(tails: DataFrame, counts: DataFrame, rows: int, hot: int = HOT) -> DataFrame:
    """(a, share, b, joint_count) from tails (a, partners, n). `counts` has the customers of each product, `rows` is their sum."""
    tasks = max(tails.sparkSession.sparkContext.defaultParallelism, rows // ROWS + 1)
    met = dealt_tails(tails, counts.withColumnRenamed("customers", "n"), tasks, hot)
    return met.groupBy("a", "share", "b").agg(F.sum("n").alias("joint_count"))


def _lists(counted: DataFrame) -> DataFrame:
    """(a, partners, n). The pairs of a product and share are in one task already."""
    return counted.groupBy("a", "share", F.col("joint_count").alias("n")).agg(F.collect_list("b").alias("partners")).select("a", "partners", "n")


def _pairs(lists: DataFrame) -> DataFrame:
    return lists.select("a", F.explode("partners").alias("b"), F.col("n").alias("joint_count"))


def _once(tails: DataFrame) -> DataFrame:
    return tails.withColumn("n", F.lit(1).cast("bigint"))


def _customers(contents: DataFrame) -> DataFrame:
    return contents.groupBy("item").agg(F.count(F.lit(1)).alias("customers"))


def in_parts(state: History, least: int = 1) -> DataFrame:
    """The lists of all pairs with at least `least` customers, counted and stored one part after the other."""
    spark = state.contents.sparkSession
    held = F.count(F.lit(1)).cast("bigint")
    held = state.contents.groupBy("customer_key").agg((held * (held - 1)).alias("twice"))
    parts = (held.agg(F.sum("twice").alias("twice")).first()["twice"] or 0) // 2 // PART + 1
    found = []
    for part in range(parts):
        since = folders_made()
        found.append(stage_and_clear(state.lists_of(part, parts).filter(F.col("n") >= least), "history-part"))
        drop_folders(spark, since)
    return reduce(DataFrame.unionByName, found)


def build_history(items: DataFrame, block: int = BLOCK, stored: bool = True) -> History:
    """State of all lines: (customer_key, product_id, combination_id), repeats allowed.

    A state that is read once and not kept need not have its pairs `stored`.
    """
    contents = stage_and_clear(contents_of(items), "history")
    counts = stage_and_clear(_customers(contents), "history-counts")
    groups = stage_and_clear(_groups_within(contents, block), "history-groups")
    rows = contents.count()

    def counted(part: int, parts: int) -> DataFrame:
        return _lists(_counted(_once(_tails(groups, part, parts)), counts, rows // parts))

    state = History(contents, counts, contents.agg(F.count_distinct("customer_key").alias("customers")), counted)
    return replace(state, lists=in_parts(state)) if stored else state


def update_history(state: History, items: DataFrame, block: int = BLOCK, stored: bool = True) -> History:
    """The state with more lines. Only customers with new products are read again, and only pairs with one are counted."""
    key = ["customer_key", "item"]
    fresh = stage_and_clear(contents_of(items).join(state.contents, key, "left_anti"), "history-fresh")
    touched = fresh.select("customer_key").distinct()
    newcomers = touched.join(state.contents, "customer_key", "left_anti")
    total = state.total.unionByName(newcomers.agg(F.count(F.lit(1)).alias("customers"))).agg(F.sum("customers").alias("customers"))
    total = stage_and_clear(total, "history-total")
    counts = state.counts.unionByName(_customers(fresh)).groupBy("item").agg(F.sum("customers").alias("customers"))
    counts = stage_and_clear(counts, "history-counts")
    contents = state.contents.unionByName(fresh)
    contents = stage_and_clear(contents, "history") if stored else contents
    since = folders_made()
    before = stage_and_clear(state.contents.join(touched, "customer_key", "left_semi"), "history-touched")
    groups = stage_and_clear(_groups_within(fresh, block).unionByName(_groups_between(fresh, before, block)), "history-groups")
    drop_folders(contents.sparkSession, since)
    rows = contents.count()

    def counted(part: int, parts: int) -> DataFrame:
        known = state.lists_of(part, parts)
        known = stage_and_clear(known, "history-known") if state.lists is None else known
        return _lists(_counted(known.unionByName(_once(_tails(groups, part, parts))), counts, rows // parts))

    state_after = History(contents, counts, total, counted)
    return replace(state_after, lists=in_parts(state_after)) if stored else state_after


def history_evidence(state: History, least: int = 1) -> DataFrame:
    """Directed pairs with counts and metrics, of pairs with at least `least` customers; every customer with a product counts in the total."""
    count = lambda item, name: state.counts.select(F.col("item").alias(item), F.col("customers").alias(name))
    # most pairs have one customer: those that a threshold drops are not joined
    lists = in_parts(state, least) if state.lists is None else state.lists.filter(F.col("n") >= least)
    counted = _pairs(lists).join(count("a", "source_count"), "a").join(count("b", "target_count"), "b")
    directed = mirror(counted, {"source_count": "target_count"})
    return metrics(directed.withColumn("total_transactions", state.total.scalar()))
