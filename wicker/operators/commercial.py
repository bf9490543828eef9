"""Commercial candidates: related products that may be offered, scored and ranked.

`requests`: request_id, source product, relationship_types, excluded / cart /
purchased (arrays of product keys), include_out_of_stock, budget_currency,
budget_max, limit. `data`: one row per product with available, sellable,
active, stock_status, currency, amount, margin_signal, compatibility.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wicker.functions.cascade import codes, first_match, with_code
from wicker.functions.keys import blank, identity_order, join_on, product_key
from wicker.functions.ranking import top_k
from wicker.operators.lookup import matches
from wicker.operators.snapshot import canonical_keys
from wicker.params import EligibilityParams

TARGET = ["target_product_id", "target_combination_id"]
DATA = ["available", "sellable", "active", "stock_status", "currency", "amount", "margin_signal", "compatibility"]
DEFAULT_LIMIT, MAXIMUM_LIMIT = 5, 20


def metric(name: str) -> Column:
    """Evidence value; 0 for evidence that has no such value."""
    return F.when(F.col("evidence_kind") == "co_occurrence", F.col(name)).otherwise(F.lit(0)).cast("double")


def metric_order() -> list[Column]:
    return [metric(m).desc() for m in ("lift", "confidence", "support", "joint_count")]


def mark_duplicate_targets(df: DataFrame) -> DataFrame:
    """Adds `duplicate`: another edge of the request wins the same target.

    A group holds the edges between two products, one per relationship type.
    """
    window = Window.partitionBy("request_id", *TARGET).orderBy(
        F.col("reliability").desc(), *metric_order(), *canonical_keys()
    )
    return df.withColumn("duplicate", F.row_number().over(window) > 1)


def attach_commercial(df: DataFrame, data: DataFrame) -> DataFrame:
    """Commercial data of the target; `has_data` is false where there is none."""
    renamed = data.select(
        F.col("product_id").alias(TARGET[0]),
        F.col("combination_id").alias(TARGET[1]),
        *DATA,
        F.lit(True).alias("has_data"),
    )
    return join_on(df, renamed, TARGET, "left").withColumn("has_data", F.coalesce("has_data", F.lit(False)))


def _flags(p: EligibilityParams) -> dict[str, Column]:
    target = product_key(*TARGET)

    def listed(name: str) -> Column:
        return F.coalesce(F.array_contains(F.col(name), target), F.lit(False))

    include = F.coalesce(F.col("include_out_of_stock"), F.lit(False))
    out = (F.col("stock_status") == "out_of_stock") | ~F.col("available")
    budget = F.col("budget_currency").isNotNull()
    same_currency = F.col("currency") == F.col("budget_currency")
    priced = F.col("amount").isNotNull()
    return {
        "excluded": listed("excluded"),
        "in_cart": listed("cart"),
        "purchased": listed("purchased"),
        "out": out,
        "drop_out": out & ~include if p.exclude_out_of_stock else F.lit(False),
        "budget_no_price": budget & ~priced,
        "budget_mismatch": budget & priced & ~same_currency,
        "in_currency": budget & priced & same_currency,
    }


def eligibility_code(p: EligibilityParams = EligibilityParams()) -> Column:
    f = _flags(p)
    combination = F.col(TARGET[1])
    bad = blank(TARGET[0]) | (combination.isNotNull() & blank(combination))
    same = product_key(*TARGET) == product_key("source_product_id", "source_combination_id")
    rules = [(bad, "INVALID_PRODUCT_IDENTITY"), (same, "SOURCE_PRODUCT"), (f["excluded"], "EXPLICITLY_EXCLUDED")]
    if p.exclude_cart:
        rules.append((f["in_cart"], "ALREADY_IN_CART"))
    if p.exclude_purchased:
        rules.append((f["purchased"], "ALREADY_PURCHASED"))
    rules += [
        (~F.col("active"), "INACTIVE"),
        (~F.col("sellable"), "NOT_SELLABLE"),
        (f["drop_out"], "OUT_OF_STOCK"),
        (F.col("compatibility") == "incompatible", "INCOMPATIBLE"),
    ]
    if p.reject_unknown_compatibility:
        rules.append((F.col("compatibility") == "unknown", "UNKNOWN_COMPATIBILITY"))
    rules.append((f["in_currency"] & (F.col("amount") > F.col("budget_max")), "ABOVE_BUDGET"))
    return first_match(rules)


def judge(requests: DataFrame, edges: DataFrame, data: DataFrame, p: EligibilityParams = EligibilityParams()) -> DataFrame:
    """All candidates of all requests with reject_code (NULL = eligible)."""
    candidates = attach_commercial(mark_duplicate_targets(matches(requests, edges)), data)
    code = first_match(
        [(F.col("duplicate"), "DUPLICATE_TARGET"), (~F.col("has_data"), "MISSING_COMMERCIAL_DATA")]
    )
    return with_code(candidates, "reject_code", F.coalesce(code, eligibility_code(p)))


def warning_codes(p: EligibilityParams = EligibilityParams()) -> Column:
    f = _flags(p)
    low, unknown = F.col("stock_status") == "low_stock", F.col("stock_status") == "unknown"
    return codes(
        [
            (f["in_cart"], "ALREADY_IN_CART"),
            (f["purchased"], "ALREADY_PURCHASED"),
            (f["out"], "OUT_OF_STOCK_INCLUDED"),
            (~f["out"] & low, "LOW_STOCK"),
            (~f["out"] & unknown, "UNKNOWN_STOCK"),
            (F.col("compatibility") == "unknown", "UNKNOWN_COMPATIBILITY"),
            (f["budget_no_price"], "PRICE_UNAVAILABLE"),
            (f["budget_mismatch"], "CURRENCY_MISMATCH"),
        ]
    )


def reasons(p: EligibilityParams = EligibilityParams()) -> Column:
    """Reason codes with their contribution, in a fixed order."""
    f = _flags(p)
    status = F.col("stock_status")
    co = F.col("evidence_kind") == "co_occurrence"
    none = F.lit(None).cast("double")
    rules = [
        (~f["out"] & (status == "low_stock"), "LOW_STOCK", F.lit(2.0)),
        (~f["out"] & ~status.isin("low_stock", "unknown"), "AVAILABLE", F.lit(5.0)),
        (F.col("compatibility") == "compatible", "COMPATIBLE", F.lit(5.0)),
        (f["in_currency"], "WITHIN_BUDGET", none),
        (F.col("reliability") >= 0.7, "STRONG_RELATIONSHIP", F.col("reliability")),
        (co & (F.col("confidence") >= 0.5), "HIGH_CONFIDENCE", F.col("confidence")),
        (co & (F.col("lift") >= 2), "HIGH_LIFT", F.col("lift")),
        (F.col("margin_signal") == "high", "HIGH_MARGIN_SIGNAL", F.lit(3.0)),
    ]
    return F.array_compact(
        F.array(*[F.when(c, F.struct(F.lit(code).alias("code"), v.alias("contribution"))) for c, code, v in rules])
    )


def _clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c))


def score(df: DataFrame) -> DataFrame:
    """Adds the score components and `total` in 0..100. Needs `warnings`."""
    status, margin = F.col("stock_status"), F.col("margin_signal")
    relationship = (
        F.col("reliability") * 45
        + metric("confidence") * 20
        + _clamp((metric("lift") - 1) / 4, 0, 1) * 15
        + _clamp(metric("support") / F.lit(0.1), 0, 1) * 10
    )
    points = {"ALREADY_IN_CART": -20, "OUT_OF_STOCK_INCLUDED": -15, "PRICE_UNAVAILABLE": -2, "CURRENCY_MISMATCH": -2}
    penalties = F.lit(0.0)
    for code, value in points.items():
        penalties = penalties + F.when(F.array_contains("warnings", code), F.lit(float(value))).otherwise(0.0)
    scored = (
        df.withColumn("score_relationship", relationship)
        .withColumn(
            "score_availability",
            F.when(status == "in_stock", 5.0).when(status == "low_stock", 2.0).when(status == "out_of_stock", -15.0).otherwise(0.0),
        )
        .withColumn("score_compatibility", F.when(F.col("compatibility") == "compatible", 5.0).otherwise(0.0))
        .withColumn("score_commercial", F.when(margin == "high", 3.0).when(margin == "medium", 2.0).otherwise(0.0))
        .withColumn("score_penalties", penalties)
    )
    parts = ["score_relationship", "score_availability", "score_compatibility", "score_commercial", "score_penalties"]
    total = F.col(parts[0])
    for name in parts[1:]:
        total = total + F.col(name)
    return scored.withColumn("total", _clamp(total, 0, 100))


def scored_candidates(judged: DataFrame, p: EligibilityParams = EligibilityParams()) -> DataFrame:
    """Eligible candidates with reasons, warnings and score."""
    eligible = judged.filter(F.col("reject_code").isNull()).drop("reject_code", "duplicate", "has_data")
    return score(eligible.withColumn("reasons", reasons(p)).withColumn("warnings", warning_codes(p)))


def rank_order() -> list[Column]:
    status = F.col("stock_status")
    stock = F.when(status == "in_stock", 3).when(status == "low_stock", 2).when(status == "unknown", 1).otherwise(0)
    return [
        F.col("total").desc(),
        F.col("reliability").desc(),
        (F.col("compatibility") == "compatible").desc(),
        stock.desc(),
        *[metric(m).desc() for m in ("confidence", "lift", "support", "joint_count")],
        *identity_order("target_"),
    ]


def commercial_top(scored: DataFrame) -> DataFrame:
    """Best candidates per request with `rank`, up to the limit of the request."""
    best = top_k(scored, ["request_id"], rank_order(), MAXIMUM_LIMIT, "rank")
    return best.filter(F.col("rank") <= F.least(F.coalesce("limit", F.lit(DEFAULT_LIMIT)), F.lit(MAXIMUM_LIMIT)))


def commercial_stats(requests: DataFrame, judged: DataFrame) -> DataFrame:
    """Counters per request, requests without edges included."""
    code = F.col("reject_code")
    duplicate = code == "DUPLICATE_TARGET"
    limit = F.least(F.coalesce("limit", F.lit(DEFAULT_LIMIT)), F.lit(MAXIMUM_LIMIT))
    counted = judged.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("relationships_read"),
        F.count_if(code.isNull() | ~duplicate).alias("deduplicated_candidates"),
        F.count_if(duplicate).alias("duplicates_removed"),
        F.count_if(code.isNull()).alias("eligible_candidates"),
        F.count_if(code.isNotNull()).alias("rejected_candidates"),
    )
    names = [c for c in counted.columns if c != "request_id"]
    filled = requests.select("request_id", limit.alias("__limit")).join(counted, "request_id", "left").fillna(0, names)
    return filled.select(
        "request_id",
        *names,
        F.col("deduplicated_candidates").alias("commercial_records_requested"),
        F.col("eligible_candidates").alias("scored_candidates"),
        F.least("eligible_candidates", F.col("__limit").cast("bigint")).alias("recommendations_returned"),
    )


def stats_consistent() -> Column:
    """The four identities of the counters."""
    read, dedup, dup = F.col("relationships_read"), F.col("deduplicated_candidates"), F.col("duplicates_removed")
    return (
        (read == dedup + dup)
        & (F.col("eligible_candidates") + F.col("rejected_candidates") == read)
        & (F.col("scored_candidates") == F.col("eligible_candidates"))
        & (F.col("recommendations_returned") <= F.col("scored_candidates"))
    )


def commercial_data(truth: DataFrame) -> DataFrame:
    """Commercial data of a candidate out of the catalogue truth."""
    status = (
        F.when(F.col("status") == "unknown", "unknown")
        .when(~F.col("purchasable"), "out_of_stock")
        .when(F.coalesce("stock_quantity", F.lit(0)) <= 5, "low_stock")
        .otherwise("in_stock")
    )
    return truth.select(
        "product_id",
        "combination_id",
        F.col("purchasable").alias("available"),
        F.col("purchasable").alias("sellable"),
        "active",
        status.alias("stock_status"),
        "currency",
        F.col("final_gross").cast("double").alias("amount"),
        F.lit("unknown").alias("margin_signal"),
        F.lit("compatible").alias("compatibility"),
    )
