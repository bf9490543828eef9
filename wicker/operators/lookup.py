"""Reads of a snapshot by source product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wicker.functions.keys import beside, blank, identity_order, join_on
from wicker.functions.ranking import top_k
from wicker.operators.snapshot import canonical_keys
from wicker.operators.validate import IDENTITY, SOURCE


def index_checks(edges: DataFrame, meta: DataFrame) -> DataFrame:
    """Violations of the read contract: count, model, window, references, repeats.

    `meta` is the one metadata row of the snapshot.
    """
    declared = F.broadcast(meta.select(  # one row
        F.col("relationship_count").alias("d_count"),
        F.col("model_version").alias("d_model"),
        F.col("window_from").alias("d_from"),
        F.col("window_to").alias("d_to"),
    ))
    zero = F.lit(0).cast("bigint")
    groups = edges.groupBy(*IDENTITY).agg(F.count(F.lit(1)).alias("n"))
    bad = (
        blank("source_product_id")
        | blank("target_product_id")
        | (F.col("source_combination_id").isNotNull() & blank("source_combination_id"))
        | (F.col("target_combination_id").isNotNull() & blank("target_combination_id"))
    )
    n = F.col("n")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS")
    per_value = groups.groupBy("model_version", stamp("window_from").alias("wf"), stamp("window_to").alias("wt")).agg(
        F.sum("n").alias("n"), F.sum(n - 1).alias("repeats"), F.sum(F.when(bad, n).otherwise(zero)).alias("bad")
    )
    counted = declared.join(per_value, F.lit(True), "left").agg(
        F.abs(F.coalesce(F.sum("n"), zero) - F.coalesce(F.max("d_count"), zero)).alias("RELATIONSHIP_COUNT"),
        F.coalesce(F.sum(F.when(~F.col("model_version").eqNullSafe(F.col("d_model")), n).otherwise(zero)), zero).alias(
            "MODEL_VERSION"
        ),
        F.coalesce(
            F.sum(
                F.when(~(F.col("wf").eqNullSafe(F.col("d_from")) & F.col("wt").eqNullSafe(F.col("d_to"))), n).otherwise(zero)
            ),
            zero,
        ).alias("EVIDENCE_WINDOW"),
        F.coalesce(F.sum("bad"), zero).alias("PRODUCT_REFERENCE"),
        F.coalesce(F.sum("repeats"), zero).alias("DUPLICATE_RELATIONSHIP"),
    )
    return counted.unpivot([], counted.columns, "check", "violations")


def matches(requests: DataFrame, edges: DataFrame, how: str = "inner") -> DataFrame:
    """Edges of every request's source and types (NULL types = all).

    The type test is part of the edge side of the join: a request without a
    match survives a left join.
    """
    r = requests.withColumnsRenamed({c: f"__r_{c}" for c in SOURCE})
    wanted = F.col("relationship_types").isNull() | F.array_contains(
        F.col("relationship_types"), F.col("relationship_type")
    )
    condition = wanted
    for c in SOURCE:
        condition = condition & F.col(f"__r_{c}").eqNullSafe(F.col(c))
    joined = r.join(edges, condition, how)
    return joined.drop(*SOURCE).withColumnsRenamed({f"__r_{c}": c for c in SOURCE})


def find_by_source(requests: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per returned edge, in snapshot order, with totals per request.

    A request whose source has no edges keeps one row without a target. Groups
    are the edges of one source.
    """
    found = matches(requests, edges, "left")
    whole = Window.partitionBy("request_id")
    hit = F.col("target_product_id").isNotNull()
    ranked = (
        found.withColumn("position", F.row_number().over(whole.orderBy(*canonical_keys())))
        .withColumn("total_matched", F.count_if(hit).over(whole))
        .withColumn("returned", F.least(F.col("total_matched"), F.coalesce(F.col("limit"), F.col("total_matched"))))
    )
    kept = (F.col("position") <= F.col("returned")) | (F.col("total_matched") == 0)
    return ranked.filter(kept).withColumn("position", F.when(hit, F.col("position")))


def relatedness() -> list[Column]:
    return [
        F.col("reliability").desc(),
        F.col("confidence").desc_nulls_last(),
        F.col("lift").desc_nulls_last(),
        F.col("joint_count").desc_nulls_last(),
        *identity_order("target_"),
        F.col("relationship_type").asc(),
    ]


def find_related(sources: DataFrame, edges: DataFrame, types: list[str] | None, k: int) -> DataFrame:
    """Strongest k edges of every listed source, ranks from 1."""
    if not 1 <= k <= 100:
        raise ValueError("limit per source must be from 1 to 100")
    if types is not None and (not types or len(set(types)) != len(types)):
        raise ValueError("relationship types must be distinct")
    wanted = edges if types is None else edges.filter(F.col("relationship_type").isin(types))
    listed = join_on(wanted, sources.select(*SOURCE).distinct(), SOURCE, "left_semi")
    return top_k(listed, SOURCE, relatedness(), k, "rank")


def snapshot_metadata(edges: DataFrame, meta: DataFrame) -> DataFrame:
    """Declared metadata plus the number of sources."""
    sources = edges.agg(F.count_distinct(F.struct(*SOURCE)).alias("source_count"))
    return beside(meta, sources)
