"""Validation of relationship edges: one ordered cascade, then keep-first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wicker.functions.cascade import first_match, with_code
from wicker.functions.keys import beside, blank, product_key
from wicker.functions.ranking import mark_repeats
from wicker.params import ValidationParams

SOURCE = ["source_product_id", "source_combination_id"]
TARGET = ["target_product_id", "target_combination_id"]
WINDOW = ["window_from", "window_to"]
IDENTITY = [*SOURCE, *TARGET, "relationship_type", "model_version", *WINDOW]
EVIDENCE = [
    "evidence_kind",
    "joint_count",
    "source_count",
    "target_count",
    "total_transactions",
    "support",
    "confidence",
    "lift",
    "transition_count",
    "transition_probability",
    "median_lag_days",
    "rule_id",
    "rule_version",
]
EDGE = [*SOURCE, *TARGET, "relationship_type", *EVIDENCE, "reliability", *WINDOW, "model_version"]

# fixed values: which relationship types each kind of evidence supports
KIND_TYPES = {
    "co_occurrence": ["same_cart", "same_order", "customer_history"],
    "transition": ["next_purchase"],
    "rule": ["technical_compatibility", "manual"],
}


def complete_edges(df: DataFrame) -> DataFrame:
    """All evidence columns, NULL where the evidence kind has no such value."""
    types = {
        "transition_count": "bigint",
        "transition_probability": "double",
        "median_lag_days": "double",
        "rule_id": "string",
        "rule_version": "string",
    }
    missing = {c: F.lit(None).cast(t) for c, t in types.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def _not_finite(name: str) -> Column:
    c = F.col(name)
    return c.isNotNull() & (F.isnan(c) | (F.abs(c) == float("inf")))


def _bad_reference(prefix: str) -> Column:
    combination = F.col(f"{prefix}_combination_id")
    return blank(f"{prefix}_product_id") | (combination.isNotNull() & blank(combination))


def _kind_matches() -> Column:
    kind, rel = F.col("evidence_kind"), F.col("relationship_type")
    match = F.lit(False)
    for name, types in KIND_TYPES.items():
        match = match | ((kind == name) & rel.isin(types))
    return F.coalesce(match, F.lit(False))


def _outside(name: str, low: float, high: float | None = None) -> Column:
    c = F.col(name)
    bad = c.isNull() | F.isnan(c) | (c < low)
    return bad | (c > high) if high is not None else bad


def rule_cascade(p: ValidationParams) -> Column:
    """Code of the first rule an edge breaks, apart from repeats and the contract."""
    known_types = [t for types in KIND_TYPES.values() for t in types]
    joint, sources, targets, total = (
        F.col(c) for c in ("joint_count", "source_count", "target_count", "total_transactions")
    )
    co = F.col("evidence_kind") == "co_occurrence"
    counted = co & sources.isNotNull() & targets.isNotNull() & total.isNotNull()
    numbers = ["support", "confidence", "lift", "transition_probability", "median_lag_days", "reliability"]
    unserialisable = F.lit(False)
    for name in numbers:
        unserialisable = unserialisable | _not_finite(name)

    def off(name: str, expected: Column) -> Column:
        return F.abs(F.col(name) - expected) > p.tolerance

    share = targets / total
    rules: list[tuple[Column, str]] = [
        (unserialisable, "NON_SERIALIZABLE_RELATIONSHIP"),
        (_bad_reference("source"), "INVALID_SOURCE_PRODUCT"),
        (_bad_reference("target"), "INVALID_TARGET_PRODUCT"),
        (product_key(*SOURCE) == product_key(*TARGET), "SELF_RELATIONSHIP"),
        (~F.coalesce(F.col("relationship_type").isin(known_types), F.lit(False)), "UNSUPPORTED_RELATIONSHIP_TYPE"),
        (~_kind_matches(), "EVIDENCE_TYPE_MISMATCH"),
        (
            F.col("window_from").isNull() | F.col("window_to").isNull() | (F.col("window_from") > F.col("window_to")),
            "INVALID_EVIDENCE_WINDOW",
        ),
        (blank("model_version"), "INVALID_MODEL_VERSION"),
        (_outside("reliability", 0, 1), "INVALID_RELIABILITY"),
        (co & _outside("support", 0, 1), "INVALID_SUPPORT"),
        (co & _outside("confidence", 0, 1), "INVALID_CONFIDENCE"),
        (co & _outside("lift", 0), "INVALID_LIFT"),
        (co & (joint.isNull() | (joint < 0)), "INVALID_JOINT_COUNT"),
        (co & (F.col("relationship_type") == "same_order") & (joint == 0), "INVALID_JOINT_COUNT"),
        (co & ((sources <= 0) | (targets <= 0) | (total <= 0)), "INVALID_EVIDENCE_COUNTS"),
        (
            counted & ((joint > sources) | (joint > targets) | (sources > total) | (targets > total)),
            "INCONSISTENT_EVIDENCE_COUNTS",
        ),
        (counted & off("support", joint / F.nullif(total, F.lit(0))), "INCONSISTENT_SUPPORT"),
        (counted & off("confidence", joint / F.nullif(sources, F.lit(0))), "INCONSISTENT_CONFIDENCE"),
        (
            counted & (total > 0) & (share > 0) & off("lift", F.col("confidence") / F.nullif(share, F.lit(0.0))),
            "INCONSISTENT_LIFT",
        ),
    ]
    if p.reject_negative_association:
        rules.append((co & (F.col("lift") <= 1), "NON_POSITIVE_ASSOCIATION"))
    rules.append((F.col("reliability") < p.min_reliability, "RELIABILITY_BELOW_MINIMUM"))
    return first_match(rules)


def contract_broken() -> Column:
    """What only the full contract of the other evidence kinds rejects."""
    kind = F.col("evidence_kind")
    transition = (
        F.col("transition_count").isNull()
        | (F.col("transition_count") < 0)
        | _outside("transition_probability", 0, 1)
        | F.coalesce(F.col("median_lag_days") < 0, F.lit(False))
    )
    rule = blank("rule_id") | blank("rule_version")
    return F.coalesce(((kind == "transition") & transition) | ((kind == "rule") & rule), F.lit(False))


def validate(edges: DataFrame, p: ValidationParams = ValidationParams()) -> DataFrame:
    """Adds reject_code (NULL = accepted). `seq` gives the input order of repeats."""
    checked = with_code(edges, "reject_code", rule_cascade(p))
    marked = mark_repeats(
        checked,
        IDENTITY,
        ["seq"],
        "__repeat",
        among=F.col("reject_code").isNull(),
        holders=~contract_broken(),
    )
    late = first_match(
        [(F.col("__repeat"), "DUPLICATE_RELATIONSHIP"), (contract_broken(), "NON_SERIALIZABLE_RELATIONSHIP")]
    )
    return marked.withColumn("reject_code", F.coalesce("reject_code", late)).drop("__repeat")


def accepted(validated: DataFrame) -> DataFrame:
    return validated.filter(F.col("reject_code").isNull()).drop("reject_code")


def rejected(validated: DataFrame) -> DataFrame:
    return validated.filter(F.col("reject_code").isNotNull())


def stats(validated: DataFrame) -> DataFrame:
    """Counters, rejections by code, and distinct accepted sources and targets."""
    ok = F.col("reject_code").isNull()
    by_code = (
        validated.groupBy("reject_code")
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.sum("n").alias("relationships_read"),
            F.coalesce(F.sum(F.when(ok, F.col("n"))), F.lit(0).cast("bigint")).alias("relationships_accepted"),
            F.coalesce(F.sum(F.when(~ok, F.col("n"))), F.lit(0).cast("bigint")).alias("relationships_rejected"),
            # at most one entry per code
            F.map_from_entries(
                F.sort_array(F.collect_list(F.when(~ok, F.struct("reject_code", "n"))))
            ).alias("rejected_by_code"),
        )
    )
    distinct = validated.filter(ok).agg(
        F.count_distinct(F.struct(*SOURCE)).alias("distinct_source_products_accepted"),
        F.count_distinct(F.struct(*TARGET)).alias("distinct_target_products_accepted"),
    )
    return beside(by_code, distinct)


def warnings(validated: DataFrame) -> DataFrame:
    """At most one row: what the run as a whole has to say."""
    counted = validated.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("reject_code").isNull()).alias("accepted")
    ).withColumn("rejected", F.col("n") - F.col("accepted"))
    code = first_match(
        [
            (F.col("n") == 0, "EMPTY_INPUT"),
            (F.col("accepted") == 0, "NO_VALID_RELATIONSHIPS"),
            (F.col("rejected") > 0, "PARTIAL_VALIDATION_SUCCESS"),
        ]
    )
    return counted.select(code.alias("code"), "accepted", "rejected").filter(F.col("code").isNotNull())


def rollup_stats(validated: DataFrame) -> DataFrame:
    """Counters by relationship type, model and month of the window, with all subtotals, from one pass.

    `level` tells a subtotal from a group of NULLs: 0 for a whole group, 1 over all
    months, 3 over all models too, 7 for everything. An empty input gives no rows.
    """
    month = F.date_format("window_from", "yyyy-MM")
    rows = validated.select("relationship_type", "model_version", month.alias("month"), F.col("reject_code").isNull().alias("__fine"), "reliability")
    usable = F.when(F.col("__fine"), F.col("reliability"))
    return rows.rollup("relationship_type", "model_version", "month").agg(
        F.grouping_id().alias("level"),
        F.count(F.lit(1)).alias("read"),
        F.count_if("__fine").alias("accepted"),
        F.count_if(~F.col("__fine")).alias("rejected"),
        F.min(usable).alias("least_reliability"),
        F.max(usable).alias("most_reliability"),
    )
