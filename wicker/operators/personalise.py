"""Personalised order of commercial recommendations.

`recommendations`: output of the commercial stage (request_id, target, rank,
total, warnings, ...) with the request columns preferred, excluded,
budget_currency and customer_id. `affinity`: output of the affinity stage with
batch_id = request_id; None when that stage is unavailable.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wicker.functions.cascade import first_match
from wicker.functions.keys import identity_order, join_on, product_key
from wicker.operators.affinity import SIGNALS
from wicker.params import PersonalParams

TARGET = ["target_product_id", "target_combination_id"]
# fixed values: reason shown for each positive signal
SIGNAL_REASON = {
    "DIRECT_PRODUCT_PURCHASE": "CUSTOMER_PRODUCT_AFFINITY",
    "CATEGORY_PURCHASE": "CUSTOMER_CATEGORY_AFFINITY",
    "BRAND_PURCHASE": "CUSTOMER_BRAND_AFFINITY",
    "RECENT_PRODUCT_INTEREST": "RECENT_PRODUCT_INTEREST",
    "RECENT_CATEGORY_INTEREST": "RECENT_CATEGORY_INTEREST",
    "OWNED_COMPATIBLE_PRODUCT": "OWNED_COMPATIBLE_PRODUCT",
    "REPEAT_PURCHASE_PATTERN": "REPEAT_PURCHASE_PATTERN",
    "OBSERVED_SPEND_FIT": "OBSERVED_SPEND_COMPATIBILITY",
}
OWN_CODES = ["CUSTOMER_NOT_IDENTIFIED", "NO_CUSTOMER_HISTORY", "PARTIAL_CUSTOMER_HISTORY"]


def _clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def _affinity_side(affinity: DataFrame) -> DataFrame:
    return affinity.select(
        F.col("batch_id").alias("request_id"),
        F.col("product_id").alias(TARGET[0]),
        F.col("combination_id").alias(TARGET[1]),
        "affinity_score",
        F.col("confidence").alias("affinity_confidence"),
        *[f"s_{s}" for s in SIGNALS],
        "affinity_warnings",
        F.lit(True).alias("has_affinity"),
    )


def attach_affinity(recommendations: DataFrame, affinity: DataFrame | None) -> DataFrame:
    if affinity is None:
        none = {f"s_{s}": F.lit(None).cast("double") for s in SIGNALS}
        return recommendations.withColumns(
            {
                "affinity_score": F.lit(None).cast("double"),
                "affinity_confidence": F.lit(None).cast("string"),
                **none,
                "affinity_warnings": F.lit(None).cast("array<string>"),
                "has_affinity": F.lit(False),
                "affinity_given": F.lit(False),
            }
        )
    joined = join_on(recommendations, _affinity_side(affinity), ["request_id", *TARGET], "left")
    return joined.withColumn("has_affinity", F.coalesce("has_affinity", F.lit(False))).withColumn(
        "affinity_given", F.lit(True)
    )


def personalised_score(df: DataFrame, p: PersonalParams = PersonalParams()) -> DataFrame:
    """Adds all score components, `final_score` and `effective`."""
    target = product_key(*TARGET)
    multiplier = first = None
    for level, value in p.multipliers.items():
        condition = F.coalesce("affinity_confidence", F.lit("none")) == level
        multiplier = F.when(condition, F.lit(value)) if first is None else multiplier.when(condition, F.lit(value))
        first = level
    preferred = F.coalesce(F.array_contains("preferred", target), F.lit(False))
    strength = lambda s: F.coalesce(F.col(f"s_{s}"), F.lit(0.0))
    return (
        df.withColumn("commercial_score", _clamp(F.col("total") / 100))
        .withColumn("multiplier", multiplier.otherwise(F.lit(0.0)))
        .withColumn("commercial_contribution", F.col("commercial_score") * p.commercial_weight)
        .withColumn(
            "affinity_contribution",
            F.coalesce("affinity_score", F.lit(0.0)) * F.col("multiplier") * p.affinity_weight,
        )
        .withColumn("preference_boost", F.when(preferred, F.lit(p.preference_boost)).otherwise(F.lit(0.0)))
        .withColumn(
            "rejection_penalty",
            _clamp(
                strength("PRODUCT_REJECTION") * p.product_rejection
                + strength("CATEGORY_REJECTION") * p.category_rejection
            ),
        )
        .withColumn(
            "raw_score",
            F.col("commercial_contribution")
            + F.col("affinity_contribution")
            + F.col("preference_boost")
            - F.col("rejection_penalty"),
        )
        .withColumn("final_score", _clamp(F.col("raw_score")))
        .withColumn(
            "effective",
            (F.col("affinity_contribution") > 0) | (F.col("preference_boost") > 0) | (F.col("rejection_penalty") > 0),
        )
    )


def exclusion_code(p: PersonalParams) -> Column:
    return first_match(
        [
            (F.array_contains("excluded", product_key(*TARGET)), "EXPLICIT_CONTEXT_EXCLUSION"),
            (F.col("s_PRODUCT_REJECTION").isNotNull(), "EXPLICIT_PRODUCT_REJECTION"),
            (F.col("final_score") < p.min_score, "BELOW_MINIMUM_PERSONALIZED_SCORE"),
        ]
    )


def personalise(
    recommendations: DataFrame, affinity: DataFrame | None, p: PersonalParams = PersonalParams()
) -> DataFrame:
    """All candidates with scores, exclusion_code (NULL = kept) and personalised_rank.

    Without any effective personalisation among the survivors of a request the
    commercial order stays. A request holds at most the commercial limit.
    """
    scored = personalised_score(attach_affinity(recommendations, affinity), p)
    coded = scored.withColumn("exclusion_code", exclusion_code(p))
    alive = F.col("exclusion_code").isNull()
    request = Window.partitionBy("request_id", alive)
    any_effective = F.max("effective").over(request)
    order = [
        F.when(F.col("__any"), -F.col("final_score")).asc_nulls_first(),
        F.when(F.col("__any"), -F.col("commercial_score")).asc_nulls_first(),
        F.col("rank").asc(),
        *identity_order("target_"),
    ]
    ranked = coded.withColumn("__any", any_effective).withColumn(
        "personalised_rank", F.when(alive, F.row_number().over(request.orderBy(*order)))
    )
    if p.max_results is not None:
        over = F.col("personalised_rank") > p.max_results
        ranked = ranked.withColumn(
            "exclusion_code", F.when(over, F.lit("RESULT_LIMIT_TRUNCATION")).otherwise(F.col("exclusion_code"))
        ).withColumn("personalised_rank", F.when(~F.coalesce(over, F.lit(False)), F.col("personalised_rank")))
    return ranked.drop("__any")


def kept(personalised: DataFrame) -> DataFrame:
    return personalised.filter(F.col("exclusion_code").isNull())


def excluded(personalised: DataFrame) -> DataFrame:
    return personalised.filter(F.col("exclusion_code").isNotNull())


def reasons() -> Column:
    """Reason codes of a kept candidate, in display order."""
    trusted = F.coalesce(F.col("affinity_confidence") != "none", F.lit(False))
    rules = [(F.col("commercial_score") >= 0.7, "STRONG_COMMERCIAL_RELEVANCE")]
    rules += [(trusted & F.col(f"s_{s}").isNotNull(), reason) for s, reason in SIGNAL_REASON.items()]
    rules += [
        (F.col("preference_boost") > 0, "EXPLICIT_CONTEXT_PREFERENCE"),
        (~F.col("effective"), "GENERAL_COMMERCIAL_FALLBACK"),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, code in rules]))


def _affinity_code(c: Column) -> Column:
    return F.when(c.isin(OWN_CODES), c).otherwise(F.lit("AFFINITY_WARNING_PROPAGATED"))


def candidate_warnings() -> Column:
    """Warnings of one candidate, one entry per upstream warning."""
    empty = F.array().cast("array<string>")
    commercial = F.transform("warnings", lambda _: F.lit("COMMERCIAL_WARNING_PROPAGATED"))
    affinity = F.transform(F.coalesce("affinity_warnings", empty), _affinity_code)
    missing = F.when(
        F.col("affinity_given") & ~F.col("has_affinity"), F.array(F.lit("AFFINITY_MISSING_FOR_PRODUCT"))
    ).otherwise(empty)
    return F.concat(commercial, affinity, missing)


def request_warnings(requests: DataFrame, recommendations: DataFrame, affinity: DataFrame | None) -> DataFrame:
    """Warnings of a request as a whole: request_id, code, product (or NULL)."""
    none = F.lit(None).cast("string")
    budget = requests.filter(F.col("budget_currency").isNotNull()).select(
        "request_id", F.lit("PERSONALIZATION_CONTEXT_PARTIALLY_APPLIED").alias("code"), none.alias("product_key")
    )
    if affinity is None:
        gone = requests.select("request_id", F.lit("CUSTOMER_AFFINITY_UNAVAILABLE").alias("code"), none.alias("product_key"))
        return budget.unionByName(gone)
    side = _affinity_side(affinity)
    unknown = join_on(side, recommendations.select("request_id", *TARGET), ["request_id", *TARGET], "left_anti")
    ignored = unknown.select(
        "request_id",
        F.lit("AFFINITY_FOR_UNKNOWN_PRODUCT_IGNORED").alias("code"),
        product_key(*TARGET).alias("product_key"),
    )
    batch = (
        affinity.filter(F.col("batch_warning").isNotNull())
        .groupBy(F.col("batch_id").alias("request_id"))
        .agg(F.max("batch_warning").alias("w"))
        .select("request_id", _affinity_code(F.col("w")).alias("code"), none.alias("product_key"))
    )
    return budget.unionByName(ignored).unionByName(batch)


def all_warnings(requests: DataFrame, personalised: DataFrame, affinity: DataFrame | None) -> DataFrame:
    """Request warnings and those of the returned candidates."""
    own = kept(personalised).select(
        "request_id", F.explode(candidate_warnings()).alias("code"), product_key(*TARGET).alias("product_key")
    )
    return request_warnings(requests, personalised, affinity).unionByName(own)


def candidate_checks(recommendations: DataFrame, data: DataFrame, affinity: DataFrame, requests: DataFrame) -> DataFrame:
    """Violations of the input contract of this stage."""
    zero = F.lit(0).cast("bigint")

    def one(df: DataFrame, check: str, c: Column) -> DataFrame:
        return df.agg(F.coalesce(c, zero).alias("violations")).select(F.lit(check).alias("check"), "violations")

    extra = F.sum(F.col("n") - 1)
    count = F.count(F.lit(1))
    same = recommendations.groupBy("request_id", *TARGET).agg(count.alias("n"))
    ranks = recommendations.groupBy("request_id", "rank").agg(count.alias("n"))
    repeated = affinity.groupBy("batch_id", "product_id", "combination_id").agg(count.alias("n"))
    keys = data.select(F.col("product_id").alias(TARGET[0]), F.col("combination_id").alias(TARGET[1])).distinct()
    unmatched = join_on(recommendations, keys, TARGET, "left_anti")
    customers = affinity.select(F.col("batch_id").alias("request_id"), F.col("customer_id").alias("__c")).distinct()
    mismatch = requests.join(customers, "request_id").filter(
        F.col("customer_id").isNotNull() & F.col("__c").isNotNull() & (F.col("customer_id") != F.col("__c"))
    )
    return reduce(
        DataFrame.unionByName,
        [
            one(same, "DUPLICATED_COMMERCIAL_PRODUCT", extra),
            one(ranks, "DUPLICATED_RANK", extra),
            one(repeated, "DUPLICATED_AFFINITY_PRODUCT", extra),
            one(unmatched, "INCONSISTENT_COMMERCIAL_DATA", count),
            one(mismatch, "CUSTOMER_MISMATCH", count),
        ],
    )


def personalised_stats(requests: DataFrame, personalised: DataFrame, affinity: DataFrame | None) -> DataFrame:
    """Thirteen counters per request with recommendations."""
    code = F.col("exclusion_code")
    alive = code.isNull()
    counted = personalised.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("commercial_candidates_received"),
        F.count_if("has_affinity").alias("candidates_with_affinity"),
        F.count_if(~F.col("has_affinity")).alias("candidates_without_affinity"),
        F.count_if(code == "EXPLICIT_CONTEXT_EXCLUSION").alias("context_exclusions"),
        F.count_if(code == "EXPLICIT_PRODUCT_REJECTION").alias("rejection_exclusions"),
        F.count_if(code == "BELOW_MINIMUM_PERSONALIZED_SCORE").alias("minimum_score_exclusions"),
        F.count_if(code == "RESULT_LIMIT_TRUNCATION").alias("result_limit_truncations"),
        F.count_if(alive).alias("recommendations_returned"),
        F.count_if(alive & F.col("effective")).alias("with_effective_personalisation"),
        F.count_if(alive & ~F.col("effective")).alias("commercial_fallbacks"),
        F.coalesce(F.sum(F.when(alive, F.size(candidate_warnings()))), F.lit(0)).cast("bigint").alias("__own"),
    )
    whole = request_warnings(requests, personalised, affinity).groupBy("request_id").agg(
        F.count(F.lit(1)).alias("__whole"),
        F.count_if(F.col("code") == "AFFINITY_FOR_UNKNOWN_PRODUCT_IGNORED").alias("affinity_entries_ignored"),
    )
    joined = counted.join(whole, "request_id", "left")
    if affinity is not None:
        received = affinity.groupBy(F.col("batch_id").alias("request_id")).agg(
            F.count(F.lit(1)).alias("affinity_entries_received")
        )
        joined = joined.join(received, "request_id", "left")
    else:
        joined = joined.withColumn("affinity_entries_received", F.lit(0).cast("bigint"))
    filled = joined.fillna(0, ["__whole", "affinity_entries_ignored", "affinity_entries_received"])
    return filled.withColumn("warnings_generated", F.col("__own") + F.col("__whole")).drop("__own", "__whole")
