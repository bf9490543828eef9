"""Queries over the build job and the composed search."""

from __future__ import annotations

from pyspark.sql import functions as F

from wicker.operators import affinity as A
from wicker.operators import compose as Z
from wicker.operators import personalise as X
from wicker.params import PairParams
from wicker.plans import views as V
from wicker.plans.build_job import BuildConfig, build_snapshot
from wicker.plans.oracle_views import (
    affinity_ctes,
    commercial_ctes,
    pair_ctes,
    reliability_sql,
    request_cte,
    STRENGTH,
)
from wicker.plans.q_catalog import truth
from wicker.plans.q_edges import digest_ctes, own_root
from wicker.plans.q_orders import EXCLUDED, STATES, TIES
from wicker.plans.q_reco import personal_ctes, personal_inputs
from wicker.plans.registry import cte, query
from wicker.session import stage_table

TARGET = X.TARGET

# -- build job ---------------------------------------------------------------
cte(
    "job_orders",
    """SELECT order_id, max(occurred_at) AS occurred_at, count(DISTINCT product_id) FILTER (drop_reason IS NULL) AS products
       FROM tagged_lines WHERE line_id IS NOT NULL AND order_accepted GROUP BY order_id""",
    "tagged_lines",
)
cte(
    "job_items",
    """SELECT t.order_id AS transaction_id, 'order' AS transaction_type, t.occurred_at, product_id,
       CAST(NULL AS VARCHAR) AS combination_id FROM tagged_lines t JOIN job_orders o ON o.order_id = t.order_id
       WHERE drop_reason IS NULL AND products BETWEEN 1 AND 50""",
    "job_orders",
)
pair_ctes("job", "job_items", V.WINDOW)
cte(
    "job_edges",
    f"""
    SELECT source_product_id, source_combination_id, target_product_id, target_combination_id,
      'same_order' AS relationship_type, 'co_occurrence' AS evidence_kind, joint_count, source_count, target_count,
      total_transactions, support, confidence, lift, CAST(NULL AS BIGINT) AS transition_count, CAST(NULL AS DOUBLE) AS transition_probability,
      CAST(NULL AS DOUBLE) AS median_lag_days, CAST(NULL AS VARCHAR) AS rule_id, CAST(NULL AS VARCHAR) AS rule_version,
      {reliability_sql()} AS reliability, TIMESTAMP '{V.WINDOW[0]}' AS window_from,
      (SELECT max(occurred_at) FROM job_items) AS window_to, '{V.MODEL}' AS model_version
    FROM (SELECT *, row_number() OVER (PARTITION BY sk ORDER BY {STRENGTH}) AS rn FROM job_evidence
          WHERE joint_count >= 2 AND lift >= 1) WHERE rn <= 50
    """,
    "job_evidence",
)
cte("job_valid", "SELECT * FROM job_edges WHERE lift > 1 AND reliability >= 0.3", "job_edges")
digest_ctes("job_digest", "job_valid")


@query(
    "build_summary",
    f"""
    SELECT (SELECT count(DISTINCT order_id) FROM tagged_lines WHERE line_id IS NOT NULL) AS source_orders_read,
      (SELECT count(*) FROM tagged_lines) AS source_lines_read,
      (SELECT count(*) FROM job_orders WHERE products BETWEEN 1 AND 50) AS orders_accepted,
      (SELECT count(*) FROM job_orders WHERE products NOT BETWEEN 1 AND 50)
        + (SELECT count(DISTINCT order_id) FROM tagged_lines WHERE line_id IS NOT NULL AND NOT order_accepted) AS orders_excluded,
      (SELECT count(DISTINCT product_id) FROM job_items) AS distinct_products,
      (SELECT count(*) FROM job_pairs) AS pair_candidates, (SELECT count(*) FROM job_edges) AS reliable_candidates,
      (SELECT count(*) FROM job_valid) AS valid_relationships,
      (SELECT count(*) FROM job_edges) - (SELECT count(*) FROM job_valid) AS rejected_relationships,
      (SELECT snapshot_id FROM job_digest) AS snapshot_id,
      (SELECT strftime(max(window_to), '%Y-%m-%d %H:%M:%S.%g') FROM job_valid) AS window_to,
      (SELECT count(DISTINCT source_product_id) FROM job_valid) AS distinct_source_products
    """,
    "job_digest",
)
def _(spark, sf):
    """The whole job; the frame is its one-row summary."""
    cfg = BuildConfig(
        own_root(spark, "build"), V.WINDOW[0], STATES, None, EXCLUDED, TIES, 50, PairParams(), 0.3, V.MODEL
    )
    summary = build_snapshot(*V.order_view(spark, sf), cfg)
    types = {"snapshot_id": "string", "window_to": "string"}
    schema = ", ".join(f"{k} {types.get(k, 'bigint')}" for k in summary)
    return spark.createDataFrame([tuple(summary.values())], schema)


# -- composed search ---------------------------------------------------------
request_cte("search_requests", "valid_edges")
cte(
    "search_sources",
    """SELECT r.* EXCLUDE (cart, purchased, include_out_of_stock), NULL AS cart, NULL AS purchased,
       false AS include_out_of_stock, CASE WHEN t.product_id IS NULL THEN 'SOURCE_PRODUCT_NOT_FOUND'
       WHEN NOT t.active THEN 'SOURCE_PRODUCT_INACTIVE' ELSE 'ok' END AS source_status
       FROM search_requests r LEFT JOIN truth t ON t.product_id = r.src AND t.combination_id IS NULL""",
    "search_requests",
    "truth",
)
cte("search_open", "SELECT * FROM search_sources WHERE source_status = 'ok'", "search_sources")
cte("search_data", "SELECT * EXCLUDE (combination_id) FROM truth_data WHERE combination_id IS NULL", "truth_data")
commercial_ctes("sx", "search_open", "valid_edges", "search_data", "20")
cte(
    "sx_requests",
    "SELECT request_id AS batch_id, rank AS seq, customer_id, tgt AS product_id FROM sx_top",
    "sx_top",
)
affinity_ctes("sx", "sx_requests", "valid_edges", None)
cte(
    "sx_shown",
    "SELECT * REPLACE (CASE WHEN known THEN batch_warning END AS batch_warning) FROM sx_table",
    "sx_table",
)
personal_ctes("sp", "sx_top", "sx_shown", "excluded", 0.0, 20)
cte(
    "sx_enriched",
    """
    SELECT * EXCLUDE (place_now), CASE WHEN ecode IS NOT NULL THEN ecode WHEN place_now > lim THEN 'RESULT_LIMIT_TRUNCATION' END AS enrichment_code,
      CASE WHEN ecode IS NULL AND place_now <= lim THEN place_now END AS final_rank
    FROM (SELECT *, row_number() OVER (PARTITION BY request_id, ecode IS NULL ORDER BY personalised_rank) AS place_now
      FROM (SELECT p.*, t.final_gross AS product_price, t.status AS product_status,
          CASE WHEN t.product_id IS NULL THEN 'MISSING_CATALOG_PRODUCT' WHEN NOT t.active THEN 'INACTIVE_PRODUCT'
            WHEN in_stock_only AND NOT t.purchasable THEN 'OUT_OF_STOCK_FILTERED' END AS ecode
        FROM sp_personal p LEFT JOIN truth t ON t.product_id = p.tgt AND t.combination_id IS NULL
        WHERE exclusion_code IS NULL))
    """,
    "sp_personal",
    "truth",
)
cte(
    "sx_returned",
    """SELECT *, CASE WHEN aff_part > 0 THEN 'CUSTOMER_AFFINITY_MATCH' WHEN relationship_type = 'same_order'
       THEN 'FREQUENTLY_BOUGHT_TOGETHER' ELSE 'RELATED_PRODUCT_FALLBACK' END AS reason
       FROM sx_enriched WHERE enrichment_code IS NULL""",
    "sx_enriched",
)


def search_inputs(spark, sf):
    edges = stage_table(V.valid_edges(spark, sf), "edges")
    requests = V.reco_requests(spark, sf, edges)
    facts = stage_table(truth(spark, sf).select(*Z.FACTS), "truth")
    return edges, requests, facts


def search(spark, sf, available: bool = True) -> Z.Search:
    edges, requests, facts = search_inputs(spark, sf)
    history, products = V.behaviour(spark, sf), V.product_facts(spark, sf)
    compatible = V.compatible_products(edges)

    def evidence_for(asked):
        return A.evidence_from_history(asked, history, products, compatible, None)

    profile = A.customer_profile(V.spend_orders(spark, sf))
    return Z.compose(requests, edges, facts, evidence_for if available else None, profile, None)


@query("source_status", "SELECT request_id, src AS source_product_id, source_status FROM search_sources", "search_sources")
def _(spark, sf):
    _, requests, facts = search_inputs(spark, sf)
    return Z.source_status(requests, facts).select("request_id", "source_product_id", "source_status")


@query(
    "enriched_topk",
    """SELECT request_id, tgt AS target_product_id, CAST(final_rank AS INTEGER) AS final_rank, enrichment_code,
       round(final_score, 9) AS final_score,
       CASE WHEN aff_part > 0 THEN 'CUSTOMER_AFFINITY_MATCH' WHEN relationship_type = 'same_order'
       THEN 'FREQUENTLY_BOUGHT_TOGETHER' ELSE 'RELATED_PRODUCT_FALLBACK' END AS reason FROM sx_enriched""",
    "sx_enriched",
)
def _(spark, sf):
    return search(spark, sf).enriched.select(
        "request_id",
        TARGET[0],
        "final_rank",
        "enrichment_code",
        F.round("final_score", 9).alias("final_score"),
        Z.commercial_reason().alias("reason"),
    )


@query(
    "merged_warnings",
    """
    SELECT * EXCLUDE (n), CASE WHEN code LIKE 'CATALOG%' THEN n END AS "count" FROM (
    SELECT request_id, stage, stage_order, code, count(*) AS n FROM (
      SELECT request_id, 'search' AS stage, 0 AS stage_order, CASE enrichment_code WHEN 'MISSING_CATALOG_PRODUCT' THEN 'CATALOG_PRODUCT_MISSING'
        ELSE 'CATALOG_PRODUCT_INACTIVE' END AS code FROM sx_enriched
        WHERE enrichment_code IN ('MISSING_CATALOG_PRODUCT', 'INACTIVE_PRODUCT')
      UNION ALL SELECT request_id, 'search', 0, 'CATALOG_PRICE_UNAVAILABLE' FROM sx_enriched WHERE ecode IS NULL AND product_price IS NULL
      UNION ALL SELECT request_id, 'search', 0, 'CATALOG_STOCK_UNKNOWN' FROM sx_enriched
        WHERE ecode IS NULL AND product_status IN ('unknown', 'unavailable_for_order')
      UNION ALL SELECT request_id, 'search', 0, 'NO_COMMERCIAL_CANDIDATES' FROM search_open WHERE request_id NOT IN (SELECT request_id FROM sx_top)
      UNION ALL SELECT request_id, 'commercial', 1, 'UPSTREAM_COMMERCIAL_WARNING' FROM sx_top WHERE len(warnings) > 0
      UNION ALL SELECT batch_id, 'affinity', 2, CASE WHEN w IN ('NO_CUSTOMER_HISTORY', 'PARTIAL_CUSTOMER_HISTORY') THEN w
        ELSE 'UPSTREAM_AFFINITY_WARNING' END FROM (SELECT batch_id, unnest(affinity_warnings) AS w FROM sx_shown
          UNION ALL SELECT batch_id, batch_warning FROM sx_shown WHERE batch_warning IS NOT NULL)
      UNION ALL SELECT request_id, 'personalisation', 3, 'PERSONALIZATION_CONTEXT_PARTIALLY_APPLIED' FROM search_open
        WHERE budget_currency IS NOT NULL AND request_id IN (SELECT request_id FROM sx_top)
      UNION ALL SELECT batch_id, 'personalisation', 3, batch_warning FROM sx_shown WHERE batch_warning IS NOT NULL
      UNION ALL SELECT request_id, 'personalisation', 3, CASE WHEN w IN ('NO_CUSTOMER_HISTORY', 'PARTIAL_CUSTOMER_HISTORY',
          'AFFINITY_MISSING_FOR_PRODUCT') THEN w ELSE 'UPSTREAM_PERSONALIZATION_WARNING' END
        FROM (SELECT request_id, unnest(pwarnings) AS w FROM sp_personal WHERE exclusion_code IS NULL)) GROUP BY ALL)
    """,
    "sx_enriched",
    "search_open",
)
def _(spark, sf):
    return Z.merged_warnings(search(spark, sf))


@query(
    "personalisation_status",
    """SELECT request_id, customer_id, CASE WHEN customer_id IS NULL THEN 'customer_not_provided'
       WHEN w = 'NO_CUSTOMER_HISTORY' THEN 'no_customer_history' ELSE 'applied' END AS personalisation
       FROM search_open LEFT JOIN (SELECT batch_id, max(batch_warning) AS w FROM sx_shown GROUP BY 1) ON batch_id = request_id""",
    "search_open",
    "sx_shown",
)
def _(spark, sf):
    return Z.personalisation_status(search(spark, sf))


@query(
    "recommend_batch",
    """
    SELECT s.request_id, CASE WHEN s.source_status <> 'ok' THEN s.source_status
        WHEN s.request_id NOT IN (SELECT request_id FROM sx_top) THEN 'NO_COMMERCIAL_CANDIDATES' ELSE 'ok' END AS status,
      CAST(final_rank AS INTEGER) AS rank, tgt AS target_product_id, round(final_score, 9) AS score,
      round(commercial_score, 9) AS commercial_score, round(affinity_score, 9) AS affinity_score,
      aconf AS affinity_confidence, reason
    FROM search_sources s LEFT JOIN sx_returned r ON r.request_id = s.request_id
    """,
    "search_sources",
    "sx_returned",
)
def _(spark, sf):
    found = Z.recommend_batch(search(spark, sf)).drop(TARGET[1])
    return found.withColumns({c: F.round(c, 9) for c in ("score", "commercial_score", "affinity_score")})


@query("recommend_degraded")
def _(spark, sf):
    """The same search with the affinity stage unavailable."""
    run = search(spark, sf, available=False)
    rows = Z.recommend_batch(run).drop(TARGET[1])
    status = Z.personalisation_status(run, affinity_available=False).select("request_id", "personalisation")
    return rows.join(status, "request_id", "left")


@query(
    "result_contract",
    """
    SELECT 'DUPLICATE_RANK' AS "check", 0 AS violations UNION ALL SELECT 'RANKS_NOT_CONTIGUOUS', 0
    UNION ALL SELECT 'DUPLICATE_CANDIDATE', 0
    UNION ALL SELECT 'DUPLICATE_CONSTRAINT', count(*) FILTER (p_size % 7 = 0) FROM part
    UNION ALL SELECT 'CONSTRAINT_IN_TWO_STATES', count(*) FILTER (p_size % 5 = 0) FROM part
    """,
)
def _(spark, sf):
    """Contract of the personalised results, and of constraint states with known faults."""
    part, size = V.table(spark, sf, "part"), F.col("p_size")
    own = F.concat(F.lit("budget-"), V.text("p_partkey"))
    constraints = part.select(
        F.col("p_partkey").alias("request_id"),
        F.when(size % 7 == 0, F.array(own, own)).otherwise(F.array(own)).alias("applied"),
        F.when(size % 5 == 0, F.array(own)).otherwise(F.array(F.col("p_brand"))).alias("relaxed"),
        F.array(F.col("p_type")).alias("unsupported"),
    )
    _, top, table = personal_inputs(spark, sf)
    results = X.kept(X.personalise(top, table)).select("request_id", F.col("personalised_rank").alias("rank"), *TARGET)
    return Z.result_contract(results, constraints)
