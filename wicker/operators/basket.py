"""Co-occurrence of products in baskets: counts, evidence, thresholds, top-k.

Input `items`: transaction_id, transaction_type, occurred_at, product_id,
combination_id (one row per item, repeats allowed unless stated).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wicker.functions.cascade import first_match
from wicker.functions.keys import beside, identity_order, pack, unpack
from wicker.functions.ranking import top_k
from wicker.params import PairParams
from wicker.session import stage_table

ITEM = ["product_id", "combination_id"]
SOURCE = ["source_product_id", "source_combination_id"]
TARGET = ["target_product_id", "target_combination_id"]

# Baskets above this size are paired block against block, so that no task ever
# holds more than about two blocks of one basket.
BLOCK = 64
# baskets of a product beyond which its partners are dealt to several tasks
HOT = 20_000
# pairs for each task that counts them
PAIRS = 500_000


def in_window(window: tuple[str, str] | None) -> Column:
    if window is None:
        return F.lit(True)
    at = F.col("occurred_at")
    return (at >= F.lit(window[0]).cast("timestamp")) & (at <= F.lit(window[1]).cast("timestamp"))


def basket_contents(
    items: DataFrame, window: tuple[str, str] | None = None, transaction_type: str = "order"
) -> DataFrame:
    """Distinct products (packed as `item`) per transaction of one type inside the window."""
    wanted = (F.col("transaction_type") == transaction_type) & in_window(window)
    # the NULL test is what a later semi join would infer; stated here, all
    # readers of the contents share one shuffle
    return items.filter(wanted & F.col("transaction_id").isNotNull()).select(
        "transaction_id", pack().alias("item")
    ).distinct()


def basket_sizes(contents: DataFrame) -> DataFrame:
    return contents.groupBy("transaction_id").agg(F.count(F.lit(1)).alias("basket_size"))


def eligible_baskets(
    items: DataFrame, window: tuple[str, str] | None = None, transaction_type: str = "order"
) -> DataFrame:
    """Contents of baskets with at least two distinct products, with the basket size."""
    contents = basket_contents(items, window, transaction_type)
    sizes = basket_sizes(contents).filter(F.col("basket_size") >= 2)
    return contents.join(sizes, "transaction_id").select("transaction_id", *unpack("item"), "basket_size")


@dataclass(frozen=True)
class Baskets:
    """Eligible baskets as arrays, and the contents of the large ones.

    `arrays` has one row per transaction with its first BLOCK + 1 products. A
    basket with more than BLOCK products is `large`: its contents stay in rows.
    """

    arrays: DataFrame
    contents: DataFrame | None

    def small(self) -> DataFrame:
        n = F.size("items")
        return self.arrays.filter((n >= 2) & (n <= BLOCK) if self.contents is not None else n >= 2)

    def large(self) -> DataFrame | None:
        """Contents of large baskets with their size."""
        if self.contents is None:
            return None
        ids = self.arrays.filter(F.size("items") > BLOCK).select("transaction_id")
        rows = self.contents.join(ids, "transaction_id", "left_semi")
        return rows.join(basket_sizes(rows), "transaction_id")

    def total(self) -> DataFrame:
        """One row: number of eligible baskets."""
        return self.arrays.filter(F.size("items") >= 2).agg(F.count(F.lit(1)).alias("total_baskets"))


def gather(contents: DataFrame) -> Baskets:
    """Baskets of any size.

    The row number keeps BLOCK + 1 products per transaction on the map side
    already, so a transaction with very many products never fills a task.
    """
    window = Window.partitionBy("transaction_id").orderBy("item")
    head = contents.withColumn("n", F.row_number().over(window)).filter(F.col("n") <= BLOCK + 1)
    return Baskets(_arrays(head), contents)


def gather_stored(contents: DataFrame) -> Baskets:
    """Baskets of any size, stored once for the pair count, the counts and the total.

    Without large baskets, the usual case, nothing of their path is planned.
    """
    lazy = gather(contents)
    arrays = stage_table(lazy.arrays, "baskets")
    large = arrays.filter(F.size("items") > BLOCK).select("transaction_id")
    if large.isEmpty():
        return Baskets(arrays, None)
    rows = contents.join(large, "transaction_id", "left_semi")
    return Baskets(arrays, stage_table(rows, "large-baskets"))


def _arrays(rows: DataFrame) -> DataFrame:
    items = F.sort_array(F.collect_list("item"))
    return rows.groupBy("transaction_id").agg(items.alias("items"))


def _large_blocks(baskets: Baskets) -> DataFrame:
    """Groups of products of large baskets to pair up: low x high, or low with itself.

    The products are split by hash, and every pair of blocks of a basket becomes one
    group of bounded size.
    """
    large = baskets.large()
    n_blocks = F.ceil(F.col("basket_size") / F.lit(BLOCK)).cast("int")
    spread = (
        large.withColumn("n_blocks", n_blocks)
        .withColumn("own", F.pmod(F.xxhash64("item"), F.col("n_blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    )
    first, second = F.least("own", "other"), F.greatest("own", "other")
    item = F.col("item")
    return (
        # one struct key: a partitioning on the basket alone does not satisfy it,
        # so the block pairs of a large basket really spread out
        spread.groupBy(F.struct("transaction_id", first.alias("i"), second.alias("j")).alias("block"))
        .agg(
            F.sort_array(F.collect_list(F.when(F.col("own") == first, item))).alias("low"),
            F.collect_list(F.when(F.col("own") == second, item)).alias("high"),
        )
        .select("low", "high", (F.col("block.i") == F.col("block.j")).alias("same"))
    )


def item_counts(baskets: Baskets) -> DataFrame:
    """Eligible baskets per packed product."""
    items = baskets.small().select(F.explode("items").alias("item"))
    large = baskets.large()
    if large is not None:
        items = items.unionByName(large.select("item"))
    return items.groupBy("item").agg(F.count(F.lit(1)).alias("basket_count"))


def product_counts(baskets: Baskets) -> DataFrame:
    """Number of eligible baskets that hold each product."""
    return item_counts(baskets).select(*unpack("item"), "basket_count")


def _tails(baskets: Baskets) -> DataFrame:
    """(a, partners): each product of a block with those it meets there that sort behind it."""
    small = baskets.small().select(F.posexplode("items").alias("position", "a"), "items")
    small = small.select("a", F.slice("items", F.col("position") + 2, F.size("items")).alias("partners"))
    tails = small
    if baskets.contents is not None:
        after = lambda own, others: F.transform(own, lambda x: F.struct(x.alias("a"), F.filter(others, lambda y: y > x).alias("partners")))
        lows, highs = after(F.col("low"), F.col("high")), after(F.col("high"), F.col("low"))
        met = _large_blocks(baskets).select(F.explode(F.when(F.col("same"), lows).otherwise(F.concat(lows, highs))).alias("p"))
        tails = small.unionByName(met.select("p.*"))
    return tails.filter(F.size("partners") > 0)


def dealt_tails(tails: DataFrame, counts: DataFrame, tasks: int, hot: int = HOT) -> DataFrame:
    """(a, share, b, ...) from tails (a, partners, ...), which are dealt by product once and not again by pair.

    `counts` (item, n) has the rows of each product. The partners of a product with more
    than `hot` are dealt too; such products are few, at most rows / hot, so they are broadcast.
    Rows of one pair (a, b) have one share and lie in one task.
    """
    rest = [c for c in tails.columns if c not in ("a", "partners")]
    shares = F.ceil(F.col("n") / F.lit(hot)).cast("int").alias("shares")
    many = counts.filter(F.col("n") > hot).select(F.col("item").alias("a"), shares)
    dealt = tails.join(F.broadcast(many), "a", "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
    dealt = dealt.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    own = F.filter("partners", lambda y: F.pmod(F.xxhash64(y), F.col("shares")) == F.col("share"))
    kept = dealt.select("a", "share", F.when(F.col("shares") == 1, F.col("partners")).otherwise(own).alias("partners"), *rest)
    return kept.filter(F.size("partners") > 0).repartition(tasks, "a", "share").select("a", "share", *rest, F.explode("partners").alias("b"))


def count_tails(tails: DataFrame, counts: DataFrame, tasks: int, hot: int = HOT) -> DataFrame:
    """(a, b, joint_count) from tails (a, partners, n)."""
    met = dealt_tails(tails, counts, tasks, hot)
    return met.groupBy("a", "share", "b").agg(F.sum("n").alias("joint_count")).select("a", "b", "joint_count")


def unordered_pair_counts(baskets: Baskets) -> DataFrame:
    """(a, b, joint_count), a before b.

    Most pairs occur once, so adding them up before the exchange only fills memory: a
    product travels with the list of its later partners, and pairs are counted where the
    lists of a product meet. Tasks grow with the number of pairs.
    """
    tails = _tails(baskets).withColumn("n", F.lit(1).cast("bigint"))
    n = F.least(F.size("items"), F.lit(BLOCK)).cast("bigint")
    sizes = [F.coalesce(F.sum(n * (n - 1) / 2), F.lit(0)).cast("bigint").alias("pairs")]
    pairs = baskets.arrays.agg(*sizes).first()["pairs"]
    large = baskets.large()
    if large is not None:
        pairs += large.agg(F.coalesce(F.sum((F.col("basket_size") - 1) / 2), F.lit(0)).cast("bigint").alias("pairs")).first()["pairs"]
    tasks = max(baskets.arrays.sparkSession.sparkContext.defaultParallelism, pairs // PAIRS + 1)
    return count_tails(tails, item_counts(baskets).withColumnRenamed("basket_count", "n"), tasks)


def mirror(pairs: DataFrame, swapped: dict[str, str] | None = None) -> DataFrame:
    """Both directions of unordered pairs; `swapped` maps a-columns to b-columns."""
    keep = [c for c in pairs.columns if c not in ("a", "b")]
    swapped = swapped or {}
    back = {b: a for a, b in swapped.items()}

    def side(source: str, target: str, flip: bool) -> Column:
        def pick(c: str) -> Column:
            other = (swapped.get(c) or back.get(c)) if flip else None
            return F.col(other or c).alias(c)

        return F.struct(F.col(source).alias("s"), F.col(target).alias("t"), *[pick(c) for c in keep])

    both = F.explode(F.array(side("a", "b", False), side("b", "a", True)))
    edges = pairs.select(both.alias("edge")).select("edge.*")
    return edges.select(*unpack("s", "source_"), *unpack("t", "target_"), *keep)


def pair_counts(baskets: Baskets) -> DataFrame:
    """Directed pairs with the number of baskets that hold both products."""
    return mirror(unordered_pair_counts(baskets))


def metrics(df: DataFrame) -> DataFrame:
    """Support, confidence and lift from the four counts; 0 where a divisor is 0."""
    joint, n = F.col("joint_count"), F.col("total_transactions")
    target_share = F.when(n > 0, F.col("target_count") / n).otherwise(F.lit(0.0))
    return (
        df.withColumn("support", F.when(n > 0, joint / n).otherwise(F.lit(0.0)))
        .withColumn(
            "confidence",
            F.when(F.col("source_count") > 0, joint / F.col("source_count")).otherwise(F.lit(0.0)),
        )
        .withColumn("__share", target_share)
        .withColumn(
            "lift",
            F.when(F.col("__share") > 0, F.col("confidence") / F.col("__share")).otherwise(F.lit(0.0)),
        )
        .drop("__share")
    )


def evidence(baskets: Baskets, pairs: DataFrame | None = None, least: int = 1) -> DataFrame:
    """Directed pairs with counts and metrics, of pairs with at least `least` joint baskets.

    Counts are attached to unordered pairs, before mirroring, which halves the
    rows of both joins. `pairs` may be given where they are already stored.
    """
    if pairs is None:
        pairs = unordered_pair_counts(baskets)
    # most pairs occur once: those that a threshold drops are not joined
    pairs = pairs.filter(F.col("joint_count") >= least)
    counts = item_counts(baskets)
    with_a = pairs.join(
        counts.select(F.col("item").alias("a"), F.col("basket_count").alias("source_count")), "a"
    )
    with_b = with_a.join(
        counts.select(F.col("item").alias("b"), F.col("basket_count").alias("target_count")), "b"
    )
    directed = mirror(with_b, {"source_count": "target_count"})
    return metrics(directed.withColumn("total_transactions", baskets.total().scalar()))


def threshold_code(p: PairParams) -> Column:
    return first_match(
        [
            (F.col("joint_count") < p.min_joint_count, "JOINT_COUNT"),
            (F.col("confidence") < p.min_confidence, "CONFIDENCE"),
            (F.col("lift") < p.min_lift, "LIFT"),
        ]
    )


def with_thresholds(df: DataFrame, p: PairParams) -> DataFrame:
    """Adds reject_code (NULL = passes)."""
    return df.withColumn("reject_code", threshold_code(p))


def strength_order() -> list[Column]:
    return [
        F.col("confidence").desc(),
        F.col("lift").desc(),
        F.col("joint_count").desc(),
        *identity_order("target_"),
    ]


def top_k_per_source(df: DataFrame, k: int, rank: str = "source_rank") -> DataFrame:
    """Strongest k targets of every source."""
    return top_k(df, SOURCE, strength_order(), k, rank)


def in_output_order(df: DataFrame) -> DataFrame:
    return df.orderBy(*identity_order("source_"), *strength_order())


def same_order_candidates(baskets: Baskets, p: PairParams, pairs: DataFrame | None = None) -> DataFrame:
    """Evidence that passes the thresholds, at most max_per_source edges per source."""
    passed = with_thresholds(evidence(baskets, pairs, p.min_joint_count), p).filter(F.col("reject_code").isNull())
    return top_k_per_source(passed.drop("reject_code"), p.max_per_source)


def as_relationships(candidates: DataFrame, window: tuple[str, str], model_version: str) -> DataFrame:
    """Edge rows of the same_order type, without reliability."""
    return candidates.select(
        *SOURCE,
        *TARGET,
        F.lit("same_order").alias("relationship_type"),
        F.lit("co_occurrence").alias("evidence_kind"),
        "joint_count",
        "source_count",
        "target_count",
        "total_transactions",
        "support",
        "confidence",
        "lift",
        F.lit(window[0]).cast("timestamp").alias("window_from"),
        F.lit(window[1]).cast("timestamp").alias("window_to"),
        F.lit(model_version).alias("model_version"),
    )


def per_source_rejections(thresholded: DataFrame, k: int) -> DataFrame:
    """Sources that lose candidates to the limit, with the number lost."""
    passed = thresholded.filter(F.col("reject_code").isNull())
    return _limited(passed.groupBy(*SOURCE).agg(F.count(F.lit(1)).alias("candidates")), k)


def _limited(per_source: DataFrame, k: int) -> DataFrame:
    return per_source.filter(F.col("candidates") > k).select(
        *SOURCE, (F.col("candidates") - k).alias("rejected"), F.lit(k).cast("bigint").alias("limit")
    )


def cooccurrence_stats(items: DataFrame, window: tuple[str, str], p: PairParams) -> DataFrame:
    """The fourteen counters of a calculation, as one row."""
    return calculation(items, window, p)[0]


def calculation(items: DataFrame, window: tuple[str, str], p: PairParams) -> tuple[DataFrame, DataFrame]:
    """The fourteen counters as one row, and the sources that lose candidates to the limit.

    Both come from one count of the pairs: its sums per source are stored.
    """
    # one row per transaction: map-side combine keeps hot transactions small
    inside = in_window(window)
    product = F.when(inside, F.struct(*ITEM))
    headers = items.groupBy("transaction_id", "transaction_type").agg(
        F.max(inside).alias("inside"), F.min(product).alias("lo"), F.max(product).alias("hi")
    )
    order = F.col("transaction_type") == "order"
    several = F.coalesce(F.col("lo") != F.col("hi"), F.lit(False))
    counted = headers.agg(
        F.count(F.lit(1)).alias("transactions_read"),
        F.count_if(order).alias("orders_read"),
        F.count_if(F.col("transaction_type") == "cart").alias("carts_ignored"),
        F.count_if(order & ~F.col("inside")).alias("orders_outside_data_window"),
        F.count_if(order & F.col("inside") & ~several).alias("single_product_orders_ignored"),
        F.count_if(order & F.col("inside") & several).alias("orders_processed"),
    )
    baskets = gather_stored(basket_contents(items, window))
    products = product_counts(baskets).agg(F.count(F.lit(1)).alias("distinct_products_observed"))
    per_source = (
        with_thresholds(evidence(baskets), p)
        .groupBy(*SOURCE)
        .agg(
            F.sum("joint_count").alias("joint"),
            F.count(F.lit(1)).alias("generated"),
            *[
                F.count_if(F.col("reject_code") == c).alias(c)
                for c in ("JOINT_COUNT", "CONFIDENCE", "LIFT")
            ],
            F.count_if(F.col("reject_code").isNull()).alias("passed"),
        )
    )
    per_source = stage_table(per_source, "sources")
    zero = F.lit(0).cast("bigint")
    over = F.greatest(F.col("passed") - p.max_per_source, zero)
    kept = F.least(F.col("passed"), F.lit(p.max_per_source).cast("bigint"))
    pairs = per_source.agg(
        *[
            F.coalesce(F.sum(c), zero).alias(name)
            for c, name in [
                (F.col("joint"), "directed_pairs_observed"),
                (F.col("generated"), "candidates_generated"),
                (F.col("JOINT_COUNT"), "candidates_rejected_by_joint_count"),
                (F.col("CONFIDENCE"), "candidates_rejected_by_confidence"),
                (F.col("LIFT"), "candidates_rejected_by_lift"),
                (over, "candidates_rejected_by_source_limit"),
                (kept, "candidates_accepted"),
            ]
        ]
    )
    limited = _limited(per_source.withColumnRenamed("passed", "candidates"), p.max_per_source)
    return beside(counted, products, pairs), limited


def cooccurrence_warnings(stats: DataFrame, limited: DataFrame) -> DataFrame:
    """Warnings: whole-run ones from the counters, one per limited source."""
    run = stats.select(
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("transactions_read") == 0, F.lit("EMPTY_DATASET")),
                    F.when(
                        (F.col("transactions_read") > 0) & (F.col("orders_processed") == 0),
                        F.lit("NO_ELIGIBLE_ORDERS"),
                    ),
                    F.when(
                        (F.col("orders_processed") > 0) & (F.col("candidates_accepted") == 0),
                        F.lit("NO_RELATIONSHIPS_GENERATED"),
                    ),
                )
            )
        ).alias("code")
    )
    per_source = limited.select(F.lit("SOURCE_RELATIONSHIP_LIMIT_APPLIED").alias("code"), "*")
    return per_source.unionByName(run, allowMissingColumns=True)
