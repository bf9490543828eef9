"""The whole search: lookup, commercial stage, affinity, personalisation, catalogue."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wicker.functions.cascade import first_match
from wicker.functions.keys import join_on, product_key
from wicker.operators import affinity as A
from wicker.operators import commercial as M
from wicker.operators import personalise as X
from wicker.params import PersonalParams
from wicker.session import stage_table

TARGET = ["target_product_id", "target_combination_id"]
SOURCE = ["source_product_id", "source_combination_id"]
POOL = 20
# what the search reads of the catalogue truth
FACTS = ["product_id", "combination_id", "name", "active", "status", "purchasable", "stock_quantity", "final_gross", "currency"]


def enrich(personalised: DataFrame, truth: DataFrame) -> DataFrame:
    """Kept candidates with catalogue data and enrichment_code (NULL = returned).

    Survivors get `final_rank` from 1; past the limit of the request the code is
    RESULT_LIMIT_TRUNCATION.
    """
    product = truth.select(
        F.col("product_id").alias(TARGET[0]),
        F.col("combination_id").alias(TARGET[1]),
        F.col("name").alias("product_name"),
        F.col("active").alias("product_active"),
        F.col("status").alias("product_status"),
        F.col("purchasable").alias("product_purchasable"),
        F.col("final_gross").alias("product_price"),
    )
    found = join_on(X.kept(personalised), product, TARGET, "left")
    in_stock_only = F.coalesce(F.col("in_stock_only"), F.lit(False))
    coded = found.withColumn(
        "enrichment_code",
        first_match(
            [
                (F.col("product_active").isNull(), "MISSING_CATALOG_PRODUCT"),
                (~F.col("product_active"), "INACTIVE_PRODUCT"),
                (
                    in_stock_only & ~(F.col("product_purchasable") & (F.col("product_status") == "available")),
                    "OUT_OF_STOCK_FILTERED",
                ),
            ]
        ),
    )
    alive = F.col("enrichment_code").isNull()
    window = Window.partitionBy("request_id", alive).orderBy("personalised_rank")
    ranked = coded.withColumn("final_rank", F.when(alive, F.row_number().over(window)))
    over = F.coalesce(F.col("final_rank") > F.coalesce("limit", F.lit(M.DEFAULT_LIMIT)), F.lit(False))
    return ranked.withColumn(
        "enrichment_code", F.when(over, F.lit("RESULT_LIMIT_TRUNCATION")).otherwise(F.col("enrichment_code"))
    ).withColumn("final_rank", F.when(~over, F.col("final_rank")))


def commercial_reason() -> Column:
    return (
        F.when(F.col("affinity_contribution") > 0, "CUSTOMER_AFFINITY_MATCH")
        .when(F.col("relationship_type") == "same_order", "FREQUENTLY_BOUGHT_TOGETHER")
        .otherwise("RELATED_PRODUCT_FALLBACK")
    )


def source_status(requests: DataFrame, truth: DataFrame) -> DataFrame:
    """Status of the source product of each request."""
    product = truth.select(
        F.col("product_id").alias(SOURCE[0]), F.col("combination_id").alias(SOURCE[1]), F.col("active").alias("__active")
    )
    found = join_on(requests.select("request_id", *SOURCE), product, SOURCE, "left")
    status = first_match(
        [(F.col("__active").isNull(), "SOURCE_PRODUCT_NOT_FOUND"), (~F.col("__active"), "SOURCE_PRODUCT_INACTIVE")], "ok"
    )
    return found.select("request_id", *SOURCE, status.alias("source_status"))


@dataclass
class Search:
    """Lazy frames of one composed run."""

    requests: DataFrame  # with source_status
    commercial: DataFrame
    affinity: DataFrame
    personalised: DataFrame
    enriched: DataFrame


def compose(
    requests: DataFrame,
    edges: DataFrame,
    truth: DataFrame,
    evidence_for: Callable[[DataFrame], DataFrame] | None,
    profile: DataFrame,
    ref_time: str | None = None,
) -> Search:
    """Run all stages for a table of requests.

    `evidence_for` turns the asked (customer, product) pairs into wide affinity
    evidence; None means that the affinity stage is unavailable and the run
    goes on with neutral affinity. A NULL `ref_time` leaves recent interest out
    and rejections without a window.
    """
    sources = source_status(requests, truth)
    open_requests = requests.join(sources.select("request_id", "source_status"), "request_id")
    usable = open_requests.filter(F.col("source_status") == "ok")
    # the pool is larger than the answer, since later stages drop candidates
    none = F.lit(None).cast("array<string>")
    pooled = usable.withColumns(
        {
            "wanted": F.col("limit"),
            "limit": F.lit(POOL),
            "cart": none,
            "purchased": none,
            "include_out_of_stock": F.lit(False),
        }
    )
    judged = M.judge(pooled, edges, M.commercial_data(truth))
    top = M.commercial_top(M.scored_candidates(judged)).withColumn("limit", F.col("wanted")).drop("wanted")
    # stages that several readers share are stored, so none is computed twice
    top = stage_table(top, "recommendations")
    asked = affinity_requests(top)
    known = F.col("known_customer")
    if evidence_for is None:
        table = A.affinity_table(asked, A.with_score(A.with_signals(A.no_evidence(asked), profile, ref_time)))
        table = table.withColumn("affinity_warnings", F.array().cast("array<string>"))
        known = F.lit(False)
    else:
        evidence = evidence_for(asked.filter(A.identified()))
        table = A.affinity_table(asked, A.with_score(A.with_signals(evidence, profile, ref_time)))
    # neutral affinity of this stage comes without warnings
    table = table.withColumn("batch_warning", F.when(known, F.col("batch_warning")))
    table = stage_table(table, "affinity")
    personalised = stage_table(X.personalise(top, table, PersonalParams(max_results=POOL)), "personalised")
    return Search(open_requests, top, table, personalised, enrich(personalised, truth))


def affinity_requests(recommendations: DataFrame) -> DataFrame:
    """Recommended products as affinity requests, one batch per request."""
    return recommendations.select(
        F.col("request_id").alias("batch_id"),
        F.col("rank").alias("seq"),
        "customer_id",
        F.col(TARGET[0]).alias("product_id"),
        F.col(TARGET[1]).alias("combination_id"),
    )


def returned(search: Search) -> DataFrame:
    """Final recommendations."""
    rows = search.enriched.filter(F.col("enrichment_code").isNull())
    return rows.withColumn("reason", commercial_reason()).withColumn("reasons", X.reasons())


def _upstream(own: list[str], fallback: str):
    return lambda c: F.when(c.isin(own), c).otherwise(F.lit(fallback))


def merged_warnings(search: Search, affinity_available: bool = True) -> DataFrame:
    """Distinct warnings per request: stage, code, stage position for display order, and for catalogue warnings the number of products.

    CUSTOMER_NOT_IDENTIFIED is not shown without a customer.
    """
    usable = search.requests.filter(F.col("source_status") == "ok").select("request_id", "customer_id")
    top = search.commercial
    counts = search.enriched.groupBy("request_id").agg(
        F.count_if(F.col("enrichment_code") == "MISSING_CATALOG_PRODUCT").alias("CATALOG_PRODUCT_MISSING"),
        F.count_if(F.col("enrichment_code") == "INACTIVE_PRODUCT").alias("CATALOG_PRODUCT_INACTIVE"),
        F.count_if(_passed() & F.col("product_price").isNull()).alias("CATALOG_PRICE_UNAVAILABLE"),
        F.count_if(_passed() & F.col("product_status").isin("unknown", "unavailable_for_order")).alias(
            "CATALOG_STOCK_UNKNOWN"
        ),
    )
    names = [c for c in counts.columns if c != "request_id"]
    own = counts.unpivot(["request_id"], names, "code", "n").filter(F.col("n") > 0).select(
        "request_id", F.lit("search").alias("stage"), "code", F.col("n").alias("count")
    )
    empty = usable.join(top.select("request_id").distinct(), "request_id", "left_anti").select(
        "request_id", F.lit("search").alias("stage"), F.lit("NO_COMMERCIAL_CANDIDATES").alias("code")
    )
    commercial = top.filter(F.size("warnings") > 0).select(
        "request_id", F.lit("commercial").alias("stage"), F.lit("UPSTREAM_COMMERCIAL_WARNING").alias("code")
    )
    to_affinity = _upstream(X.OWN_CODES, "UPSTREAM_AFFINITY_WARNING")
    per_product = search.affinity.select(F.col("batch_id").alias("request_id"), F.explode("affinity_warnings").alias("w"))
    per_batch = search.affinity.select(F.col("batch_id").alias("request_id"), F.col("batch_warning").alias("w"))
    affinity = per_product.unionByName(per_batch.filter(F.col("w").isNotNull())).select(
        "request_id", F.lit("affinity").alias("stage"), to_affinity(F.col("w")).alias("code")
    )
    shown = X.OWN_CODES + [
        "CUSTOMER_AFFINITY_UNAVAILABLE",
        "AFFINITY_MISSING_FOR_PRODUCT",
        "PERSONALIZATION_CONTEXT_PARTIALLY_APPLIED",
    ]
    to_personal = _upstream(shown, "UPSTREAM_PERSONALIZATION_WARNING")
    with_candidates = search.requests.join(top.select("request_id").distinct(), "request_id", "left_semi")
    personal = X.all_warnings(with_candidates, search.personalised, search.affinity).select(
        "request_id", F.lit("personalisation").alias("stage"), to_personal(F.col("code")).alias("code")
    )
    frames = [empty, commercial, affinity, personal]
    if not affinity_available:
        frames.append(
            top.filter(A.identified()).select(
                "request_id", F.lit("search").alias("stage"), F.lit("CUSTOMER_AFFINITY_UNAVAILABLE").alias("code")
            )
        )
    others = reduce(DataFrame.unionByName, frames).distinct().withColumn("count", F.lit(None).cast("bigint"))
    merged = own.unionByName(others).join(usable, "request_id")
    hidden = ~A.identified() & (F.col("code") == "CUSTOMER_NOT_IDENTIFIED")
    place = F.when(F.col("stage") == "search", 0).when(F.col("stage") == "commercial", 1).when(F.col("stage") == "affinity", 2)
    return merged.filter(~hidden).select("request_id", "stage", place.otherwise(3).alias("stage_order"), "code", "count")


def _passed() -> Column:
    return F.col("enrichment_code").isNull() | (F.col("enrichment_code") == "RESULT_LIMIT_TRUNCATION")


def personalisation_status(search: Search, affinity_available: bool = True) -> DataFrame:
    """Why a request was or was not personalised."""
    history = search.affinity.groupBy(F.col("batch_id").alias("request_id")).agg(
        F.max(F.coalesce(F.col("batch_warning") == "NO_CUSTOMER_HISTORY", F.lit(False))).alias("__none")
    )
    usable = search.requests.filter(F.col("source_status") == "ok").join(history, "request_id", "left")
    candidates = F.col("__none").isNotNull()
    status = first_match(
        [
            (~A.identified(), "customer_not_provided"),
            (candidates & F.lit(not affinity_available), "customer_affinity_unavailable"),
            (F.col("__none"), "no_customer_history"),
        ],
        "applied",
    )
    return usable.select("request_id", "customer_id", status.alias("personalisation"))


def recommend_batch(search: Search) -> DataFrame:
    """Recommendations by rank; a request without any keeps one row with its status."""
    rows = returned(search).select(
        "request_id",
        F.col("final_rank").alias("rank"),
        *TARGET,
        F.col("final_score").alias("score"),
        "commercial_score",
        F.coalesce("affinity_score", F.lit(0.0)).alias("affinity_score"),
        F.coalesce("affinity_confidence", F.lit("none")).alias("affinity_confidence"),
        "reason",
        "evidence_kind",
    )
    had = search.commercial.select("request_id", F.lit(True).alias("__had")).distinct()
    # an answer only carries co-occurrence evidence; other kinds void the request
    wrong = rows.filter(F.col("evidence_kind") != "co_occurrence").select("request_id", F.lit(True).alias("__wrong"))
    status = first_match(
        [
            (F.col("__had").isNull(), "NO_COMMERCIAL_CANDIDATES"),
            (F.col("__wrong"), "UPSTREAM_CONTRACT_MISMATCH"),
        ],
        "ok",
    )
    per_request = (
        search.requests.join(had, "request_id", "left")
        .join(wrong.distinct(), "request_id", "left")
        .select(
            "request_id",
            F.when(F.col("source_status") != "ok", F.col("source_status")).otherwise(status).alias("status"),
        )
    )
    answered = per_request.withColumn("__row_key", F.when(F.col("status") == "ok", F.col("request_id")))
    return answered.join(
        rows.drop("evidence_kind").withColumnRenamed("request_id", "__row_key"), "__row_key", "left"
    ).drop("__row_key")


def result_contract(results: DataFrame, constraints: DataFrame) -> DataFrame:
    """Violations of the result contract: ranks, unique products, constraint states.

    `constraints`: request_id and the arrays applied, relaxed, unsupported.
    """
    zero = F.lit(0).cast("bigint")

    def one(df: DataFrame, check: str, c: Column) -> DataFrame:
        return df.agg(F.coalesce(c, zero).alias("violations")).select(F.lit(check).alias("check"), "violations")

    per_request = results.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("rank").alias("last"), F.min("rank").alias("first")
    )
    ranks = results.groupBy("request_id", "rank").agg(F.count(F.lit(1)).alias("n"))
    products = results.groupBy("request_id", product_key(*TARGET).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    states = ["applied", "relaxed", "unsupported"]
    repeated = reduce(lambda a, b: a | b, [F.size(c) != F.size(F.array_distinct(c)) for c in states])
    pairs = [("applied", "relaxed"), ("applied", "unsupported"), ("relaxed", "unsupported")]
    overlap = reduce(lambda a, b: a | b, [F.arrays_overlap(a, b) for a, b in pairs])
    gap = (F.col("first") != 1) | (F.col("last") != F.col("n"))
    return reduce(
        DataFrame.unionByName,
        [
            one(ranks, "DUPLICATE_RANK", F.sum(F.col("n") - 1)),
            one(per_request, "RANKS_NOT_CONTIGUOUS", F.count_if(gap)),
            one(products, "DUPLICATE_CANDIDATE", F.sum(F.col("n") - 1)),
            one(constraints, "DUPLICATE_CONSTRAINT", F.count_if(repeated)),
            one(constraints, "CONSTRAINT_IN_TWO_STATES", F.count_if(overlap)),
        ],
    )
