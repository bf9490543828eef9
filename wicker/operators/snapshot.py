"""Snapshot content: order, digest, checks before publication, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wicker.functions.keys import identity_order
from wicker.operators.validate import EDGE, IDENTITY, SOURCE, TARGET

SCHEMA_VERSION = "1"
# Measures enter the digest with twelve significant digits, whatever their size.
MEASURES = ("support", "confidence", "lift", "transition_probability", "median_lag_days", "reliability")


def canonical_keys() -> list[Column]:
    return [
        *identity_order("source_"),
        *identity_order("target_"),
        F.col("relationship_type").asc(),
        F.col("model_version").asc(),
        F.col("window_from").asc(),
        F.col("window_to").asc(),
    ]


def canonical_order(df: DataFrame) -> DataFrame:
    """Total order by range partitions; files cover disjoint ranges of sources."""
    return df.repartitionByRange(*identity_order("source_"), *identity_order("target_")).sortWithinPartitions(
        *canonical_keys()
    )


def sized(text: Column) -> Column:
    """A text with its length before it, NULL as a dash: a row of such fields can be read in one way only."""
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def edge_content() -> Column:
    """All fields of one edge, evidence included, as one text."""

    def field(name: str) -> Column:
        c = F.col(name)
        if name in MEASURES:
            c = F.when(c.isNotNull(), F.format_string("%.11e", c))
        elif name in ("window_from", "window_to"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS")
        return sized(c.cast("string"))

    return F.concat(*[field(c) for c in EDGE])


def edge_fingerprint() -> Column:
    """Hash of one edge."""
    return F.sha2(edge_content(), 256)


def second_sum(edges: DataFrame) -> str:
    """Sum of hashes of another kind over all edges: tells other content under one id."""
    h = F.md5(edge_content())
    lanes = [F.sum(F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")) for i in range(2)]
    return "-".join(str(x) for x in edges.agg(*lanes).first())


def lane(hashed: str, i: int) -> Column:
    """One of four numbers of a hash; sums of them combine on the map side."""
    return F.conv(F.substring(hashed, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")


def bucket_digests(edges: DataFrame) -> DataFrame:
    """(bucket, edges, lane0 .. lane3): a digest of each bucket, independent of the order of its edges."""
    hashed = edges.select("bucket", edge_fingerprint().alias("h"))
    sums = [F.sum(lane("h", i)).cast("decimal(38,0)").alias(f"lane{i}") for i in range(4)]
    return hashed.groupBy("bucket").agg(F.count(F.lit(1)).alias("edges"), *sums)


def digest(edges: DataFrame) -> DataFrame:
    """One row: snapshot_id over all edges, independent of their order.

    Edge hashes are added up in four lanes. A sum combines on the map side, so
    no task ever sees more than its own edges and four numbers.
    """
    hashed = edges.select(
        edge_fingerprint().alias("h"),
        "model_version",
        F.date_format("window_from", "yyyy-MM-dd HH:mm:ss.SSS").alias("wf"),
        F.date_format("window_to", "yyyy-MM-dd HH:mm:ss.SSS").alias("wt"),
    )
    summed = hashed.agg(
        F.count(F.lit(1)).alias("relationship_count"),
        F.min("model_version").alias("model_version"),
        F.min("wf").alias("window_from"),
        F.max("wt").alias("window_to"),
        *[F.coalesce(F.sum(lane("h", i)), F.lit(0)).cast("decimal(38,0)").alias(f"lane{i}") for i in range(4)],
    )
    content = F.concat_ws(
        "|",
        F.lit(SCHEMA_VERSION),
        sized(F.col("model_version")),
        F.coalesce("window_from", F.lit("")),
        F.coalesce("window_to", F.lit("")),
        F.col("relationship_count").cast("string"),
        *[F.col(f"lane{i}").cast("string") for i in range(4)],
    )
    return summed.select(
        F.concat(F.lit("sha256:"), F.sha2(content, 256)).alias("snapshot_id"),
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        "model_version",
        "window_from",
        "window_to",
        "relationship_count",
    )


def publish_checks(edges: DataFrame, validated_version: Column | None = None) -> DataFrame:
    """Number of violations per check; anything above 0 stops a publication."""
    version = F.col("model_version") if validated_version is None else validated_version
    counted = (
        edges.groupBy(*IDENTITY)
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(~version.eqNullSafe(F.col("model_version"))).alias("wrong"))
        .agg(
            F.coalesce(F.sum("wrong"), F.lit(0).cast("bigint")).alias("MODEL_VERSION_MISMATCH"),
            F.greatest(F.count_distinct("model_version") - 1, F.lit(0).cast("bigint")).alias("MIXED_MODEL_VERSIONS"),
            F.greatest(
                F.count_distinct(F.struct("window_from", "window_to")) - 1, F.lit(0).cast("bigint")
            ).alias("MIXED_EVIDENCE_WINDOWS"),
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0).cast("bigint")).alias("DUPLICATE_VALIDATED_RELATIONSHIP"),
        )
    )
    names = counted.columns
    return counted.unpivot([], names, "check", "violations")


def snapshot_stats(edges: DataFrame) -> DataFrame:
    pairs = edges.groupBy(*SOURCE, *TARGET).agg(F.count(F.lit(1)).alias("n"))
    return pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("relationships_read"),
        F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("relationships_published"),
        F.count_distinct(F.struct(*SOURCE)).alias("distinct_source_products"),
        F.count_distinct(F.struct(*TARGET)).alias("distinct_target_products"),
        F.count(F.lit(1)).alias("distinct_directed_pairs"),
    )
