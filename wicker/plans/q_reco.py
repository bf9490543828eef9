"""Queries over commercial candidates, customer affinity and personalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from wicker.operators import affinity as A
from wicker.operators import commercial as M
from wicker.operators import compose as Z
from wicker.operators import lookup as L
from wicker.operators import personalise as X
from wicker.params import PersonalParams
from wicker.plans import views as V
from wicker.plans.oracle_views import ALL_SIGNALS, POSITIVE_SIGNALS, affinity_ctes, commercial_ctes, request_cte
from wicker.plans.q_catalog import truth
from wicker.plans.registry import cte, query
from wicker.session import stage_table

TARGET = X.TARGET
LIMITED = "least(lim, 20)"
request_cte("reco_requests", "knowledge")
commercial_ctes("reco", "reco_requests", "knowledge", "commercial", LIMITED)


def judged(spark, sf):
    edges = V.knowledge(spark, sf)
    requests = V.reco_requests(spark, sf, edges)
    return requests, M.judge(requests, edges, V.commercial_data(spark, sf))


def scored(spark, sf):
    return M.scored_candidates(judged(spark, sf)[1])


@query(
    "dedup_targets",
    "SELECT request_id, target_product_id, relationship_type, dup > 1 AS duplicate FROM reco_judged",
    "reco_judged",
)
def _(spark, sf):
    edges = V.knowledge(spark, sf)
    found = M.mark_duplicate_targets(L.matches(V.reco_requests(spark, sf, edges), edges))
    return found.select("request_id", TARGET[0], "relationship_type", "duplicate")


@query(
    "missing_commercial",
    """SELECT request_id, target_product_id, relationship_type FROM reco_judged
       WHERE reject_code = 'MISSING_COMMERCIAL_DATA'""",
    "reco_judged",
)
def _(spark, sf):
    found = judged(spark, sf)[1].filter(F.col("reject_code") == "MISSING_COMMERCIAL_DATA")
    return found.select("request_id", TARGET[0], "relationship_type")


@query(
    "eligibility",
    "SELECT request_id, target_product_id, relationship_type, reject_code FROM reco_judged",
    "reco_judged",
)
def _(spark, sf):
    return judged(spark, sf)[1].select("request_id", TARGET[0], "relationship_type", "reject_code")


@query(
    "reco_reasons",
    """SELECT request_id, target_product_id, relationship_type, array_to_string(reasons, ',') AS reasons,
       array_to_string(warnings, ',') AS warnings FROM reco_scored""",
    "reco_scored",
)
def _(spark, sf):
    return scored(spark, sf).select(
        "request_id",
        TARGET[0],
        "relationship_type",
        F.array_join("reasons.code", ",").alias("reasons"),
        F.array_join("warnings", ",").alias("warnings"),
    )


@query(
    "commercial_score",
    """SELECT request_id, target_product_id, relationship_type, round(s_rel, 9) AS score_relationship,
       s_avail AS score_availability, s_comp AS score_compatibility, s_margin AS score_commercial,
       s_pen AS score_penalties, round(total, 9) AS total FROM reco_scored""",
    "reco_scored",
)
def _(spark, sf):
    return scored(spark, sf).select(
        "request_id",
        TARGET[0],
        "relationship_type",
        F.round("score_relationship", 9).alias("score_relationship"),
        "score_availability",
        "score_compatibility",
        "score_commercial",
        "score_penalties",
        F.round("total", 9).alias("total"),
    )


@query(
    "commercial_topk",
    """SELECT request_id, CAST(rank AS INTEGER) AS rank, target_product_id, relationship_type,
       round(total, 9) AS total FROM reco_top""",
    "reco_top",
)
def _(spark, sf):
    return M.commercial_top(scored(spark, sf)).select(
        "request_id", "rank", TARGET[0], "relationship_type", F.round("total", 9).alias("total")
    )


@query(
    "commercial_stats",
    """SELECT r.request_id, count(tgt) AS relationships_read, count(tgt) FILTER (dup = 1) AS deduplicated_candidates,
       count(tgt) FILTER (dup > 1) AS duplicates_removed,
       count(tgt) FILTER (reject_code IS NULL) AS eligible_candidates,
       count(tgt) FILTER (reject_code IS NOT NULL) AS rejected_candidates,
       count(tgt) FILTER (dup = 1) AS commercial_records_requested,
       count(tgt) FILTER (reject_code IS NULL) AS scored_candidates,
       least(count(tgt) FILTER (reject_code IS NULL), max(r.lim)) AS recommendations_returned, true AS consistent
       FROM reco_requests r LEFT JOIN reco_judged j ON j.request_id = r.request_id GROUP BY r.request_id""",
    "reco_judged",
)
def _(spark, sf):
    return M.commercial_stats(*judged(spark, sf)).withColumn("consistent", M.stats_consistent())


cte(
    "truth_data",
    """SELECT product_id, combination_id, purchasable AS available, purchasable AS sellable, active,
       CASE WHEN status = 'unknown' THEN 'unknown' WHEN NOT purchasable THEN 'out_of_stock'
         WHEN coalesce(stock_quantity, 0) <= 5 THEN 'low_stock' ELSE 'in_stock' END AS stock_status, currency,
       CAST(final_gross AS DOUBLE) AS amount, 'unknown' AS margin_signal, 'compatible' AS compatibility FROM truth""",
    "truth",
)


@query("commercial_data", "SELECT * FROM truth_data", "truth_data")
def _(spark, sf):
    return M.commercial_data(truth(spark, sf))


# -- affinity ---------------------------------------------------------------
affinity_ctes("aff", "affinity_requests", "knowledge", V.REF_TIME)


def signals(spark, sf, ref_time=V.REF_TIME):
    asked = V.affinity_requests(spark, sf)
    evidence = A.evidence_from_history(
        asked.filter(A.identified()),
        V.behaviour(spark, sf),
        V.product_facts(spark, sf),
        V.compatible_products(V.knowledge(spark, sf)),
        ref_time,
    )
    return A.with_signals(evidence, A.customer_profile(V.spend_orders(spark, sf)), ref_time)


def affinity(spark, sf):
    return A.affinity_table(V.affinity_requests(spark, sf), A.with_score(signals(spark, sf)))


SIGNAL_ROWS = " UNION ALL ".join(
    f"""SELECT customer_id, product_id, '{code}' AS code, '{"positive" if code in POSITIVE_SIGNALS else "negative"}' AS direction,
        round(s_{n}, 9) AS strength, CAST({n}_n AS BIGINT) AS evidence_count,
        strftime({n}_t, '%Y-%m-%d %H:%M:%S') AS most_recent_at FROM aff_signals WHERE s_{n} IS NOT NULL"""
    for code, (n, _, _) in ALL_SIGNALS.items()
)


@query("affinity_signals", SIGNAL_ROWS, "aff_signals")
def _(spark, sf):
    return A.signal_rows(signals(spark, sf)).select(
        "customer_id",
        "product_id",
        "code",
        "direction",
        F.round("strength", 9).alias("strength"),
        "evidence_count",
        V.stamp("most_recent_at").alias("most_recent_at"),
    )


@query(
    "customer_profile",
    """SELECT customer_id, currency, min_spend, max_spend, round(avg_spend, 6) AS avg_spend, order_count FROM profile""",
    "profile",
)
def _(spark, sf):
    found = A.customer_profile(V.spend_orders(spark, sf))
    return found.withColumn("avg_spend", F.round("avg_spend", 6))


@query(
    "affinity_score",
    "SELECT customer_id, product_id, round(score, 9) AS affinity_score FROM aff_scores",
    "aff_scores",
)
def _(spark, sf):
    found = A.with_score(signals(spark, sf))
    return found.select("customer_id", "product_id", F.round("affinity_score", 9).alias("affinity_score"))


@query(
    "affinity_confidence",
    """SELECT customer_id, product_id, signal_types, CAST(pieces AS BIGINT) AS evidence_count, conf AS confidence
       FROM aff_scores""",
    "aff_scores",
)
def _(spark, sf):
    found = A.with_score(signals(spark, sf))
    return found.select("customer_id", "product_id", "signal_types", "evidence_count", "confidence")


@query(
    "affinity_dedup",
    """SELECT batch_id, seq, product_id FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, product_id ORDER BY seq)
       AS n FROM affinity_requests) WHERE n = 1""",
    "affinity_requests",
)
def _(spark, sf):
    found = A.mark_request_repeats(V.affinity_requests(spark, sf)).filter(~F.col("repeat"))
    return found.select("batch_id", "seq", "product_id")


@query(
    "affinity_coverage",
    """SELECT batch_id, seq, product_id, has AS has_evidence, round(affinity_score, 9) AS affinity_score, confidence,
       array_to_string(affinity_warnings, ',') AS affinity_warnings, batch_warning FROM aff_table""",
    "aff_table",
)
def _(spark, sf):
    return affinity(spark, sf).select(
        "batch_id",
        "seq",
        "product_id",
        "has_evidence",
        F.round("affinity_score", 9).alias("affinity_score"),
        "confidence",
        F.array_join("affinity_warnings", ",").alias("affinity_warnings"),
        "batch_warning",
    )


@query(
    "affinity_warnings",
    """SELECT batch_id, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY own, code) AS INTEGER) AS position, code FROM (
         SELECT r.batch_id, 0 AS own, 'AFFINITY_PROVIDER_WARNING' AS code FROM affinity_requests r WHERE r.seq % 83 = 0
           AND r.batch_id NOT IN (SELECT batch_id FROM aff_table WHERE batch_warning = 'CUSTOMER_NOT_IDENTIFIED')
         UNION ALL SELECT DISTINCT batch_id, 1, batch_warning FROM aff_table WHERE batch_warning IS NOT NULL)""",
    "aff_table",
    "affinity_requests",
)
def _(spark, sf):
    """Warnings of every batch: those that came with the evidence, then its own."""
    provider = V.affinity_requests(spark, sf).filter(F.col("seq") % 83 == 0).select("batch_id")
    return A.batch_warnings(affinity(spark, sf), provider)


def given_evidence(spark, sf):
    """Evidence filed per event, with wrong customers and foreign products among it."""
    asked = V.affinity_requests(spark, sf)
    return asked.select(
        "batch_id",
        F.when(F.col("seq") % 97 == 0, F.lit("other")).otherwise(F.col("customer_id")).alias("customer_id"),
        F.when(F.col("seq") % 89 == 0, F.concat(F.lit("z"), "product_id")).otherwise(F.col("product_id")).alias("product_id"),
        "combination_id",
    )


cte(
    "given_evidence",
    """SELECT batch_id, CASE WHEN seq % 97 = 0 THEN 'other' ELSE customer_id END AS customer_id,
       CASE WHEN seq % 89 = 0 THEN 'z' || product_id ELSE product_id END AS product_id FROM affinity_requests""",
    "affinity_requests",
)


@query(
    "evidence_checks",
    """
    SELECT 'DIFFERENT_CUSTOMER' AS "check", count(*) AS violations FROM given_evidence e
      JOIN (SELECT DISTINCT batch_id, customer_id FROM affinity_requests) r ON r.batch_id = e.batch_id
      WHERE r.customer_id IS DISTINCT FROM e.customer_id
    UNION ALL SELECT 'DUPLICATE_PRODUCT', CAST(sum(n - 1) AS BIGINT) FROM
      (SELECT count(*) AS n FROM given_evidence GROUP BY batch_id, product_id)
    UNION ALL SELECT 'OUTSIDE_BATCH', count(*) FROM given_evidence e WHERE NOT EXISTS
      (SELECT 1 FROM affinity_requests r WHERE r.batch_id = e.batch_id AND r.product_id = e.product_id)
    """,
    "given_evidence",
)
def _(spark, sf):
    return A.evidence_checks(V.affinity_requests(spark, sf), given_evidence(spark, sf))


@query(
    "affinity_stats",
    """SELECT t.batch_id, max(n) AS requested_products, count(*) AS deduplicated_products,
       max(n) - count(*) AS duplicate_products_removed, count(*) FILTER (has) AS products_with_evidence,
       count(*) FILTER (NOT has) AS products_without_evidence,
       CAST(sum(signal_types - negatives) AS BIGINT) AS positive_signals_generated,
       CAST(sum(negatives) AS BIGINT) AS negative_signals_generated,
       CAST(sum(len(affinity_warnings)) + max(CAST(batch_warning IS NOT NULL AS INTEGER)) AS BIGINT) AS warnings_generated,
       max(CAST(known AS INTEGER)) AS provider_calls
       FROM aff_table t JOIN (SELECT batch_id, count(*) AS n FROM affinity_requests GROUP BY 1) q ON q.batch_id = t.batch_id
       GROUP BY t.batch_id""",
    "aff_table",
)
def _(spark, sf):
    return A.affinity_stats(V.affinity_requests(spark, sf), affinity(spark, sf))


# -- personalisation --------------------------------------------------------
cte(
    "px_requests",
    """SELECT request_id AS batch_id, rank AS seq, customer_id, tgt AS product_id FROM reco_top
       UNION ALL SELECT request_id, 100, customer_id, src FROM reco_top WHERE rank = 1""",
    "reco_top",
)
affinity_ctes("px", "px_requests", "knowledge", V.REF_TIME)
# the personal stage of the queries: at most 2 results, floor 0.05
PX = PersonalParams(min_score=0.35, max_results=2)


def personal_ctes(prefix: str, top: str, table: str, excluded: str, floor: float, pool: int) -> None:
    cte(
        f"{prefix}_scored",
        f"""
        SELECT *, greatest(0::DOUBLE, least(1::DOUBLE, raw_score)) AS final_score,
          aff_part > 0 OR boost > 0 OR penalty > 0 AS effective
        FROM (SELECT *, com_part + aff_part + boost - penalty AS raw_score FROM
          (SELECT *, commercial_score * 0.7::DOUBLE AS com_part,
             coalesce(affinity_score, 0) * multiplier * 0.3::DOUBLE AS aff_part
           FROM (SELECT t.*, a.affinity_score, a.confidence AS aconf, a.affinity_warnings, a.product_id IS NOT NULL AS has_affinity,
               {", ".join(f"a.s_{n}" for n, _, _ in ALL_SIGNALS.values())},
               greatest(0::DOUBLE, least(1::DOUBLE, total / 100)) AS commercial_score,
               CASE a.confidence WHEN 'low' THEN 0.35::DOUBLE WHEN 'medium' THEN 0.7::DOUBLE WHEN 'high' THEN 1::DOUBLE
                 ELSE 0::DOUBLE END AS multiplier,
               CASE WHEN tgt = preferred THEN 0.1::DOUBLE ELSE 0::DOUBLE END AS boost,
               least(1::DOUBLE, coalesce(a.s_product_rejection, 0) * 1::DOUBLE
                 + coalesce(a.s_category_rejection, 0) * 0.25::DOUBLE) AS penalty
             FROM {top} t LEFT JOIN {table} a ON a.batch_id = t.request_id AND a.product_id = t.tgt)))
        """,
        top,
        table,
    )
    cte(
        f"{prefix}_personal",
        f"""
        SELECT *, CASE WHEN own_code IS NOT NULL THEN own_code WHEN place > {pool} THEN 'RESULT_LIMIT_TRUNCATION' END AS exclusion_code,
          CASE WHEN own_code IS NULL AND place <= {pool} THEN place END AS personalised_rank,
          list_filter([CASE WHEN commercial_score >= 0.7 THEN 'STRONG_COMMERCIAL_RELEVANCE' END,
            {", ".join(f"CASE WHEN aconf <> 'none' AND s_{POSITIVE_SIGNALS[s][0]} IS NOT NULL THEN '{r}' END" for s, r in X.SIGNAL_REASON.items())},
            CASE WHEN boost > 0 THEN 'EXPLICIT_CONTEXT_PREFERENCE' END,
            CASE WHEN NOT effective THEN 'GENERAL_COMMERCIAL_FALLBACK' END], lambda x: x IS NOT NULL) AS preasons,
          list_concat(list_concat(list_transform(warnings, lambda x: 'COMMERCIAL_WARNING_PROPAGATED'),
            list_transform(coalesce(affinity_warnings, []), lambda x: CASE WHEN x IN ('CUSTOMER_NOT_IDENTIFIED',
              'NO_CUSTOMER_HISTORY', 'PARTIAL_CUSTOMER_HISTORY') THEN x ELSE 'AFFINITY_WARNING_PROPAGATED' END)),
            CASE WHEN has_affinity THEN [] ELSE ['AFFINITY_MISSING_FOR_PRODUCT'] END) AS pwarnings
        FROM (SELECT *, row_number() OVER (PARTITION BY request_id, own_code IS NULL ORDER BY
            CASE WHEN any_effective THEN -final_score END NULLS FIRST, CASE WHEN any_effective THEN -commercial_score END NULLS FIRST,
            rank, tgt) AS place
          FROM (SELECT *, bool_or(effective) OVER (PARTITION BY request_id, own_code IS NULL) AS any_effective
            FROM (SELECT *, CASE WHEN tgt = {excluded} THEN 'EXPLICIT_CONTEXT_EXCLUSION'
                WHEN s_product_rejection IS NOT NULL THEN 'EXPLICIT_PRODUCT_REJECTION'
                WHEN final_score < {floor} THEN 'BELOW_MINIMUM_PERSONALIZED_SCORE' END AS own_code FROM {prefix}_scored)))
        """,
        f"{prefix}_scored",
    )


personal_ctes("px", "reco_top", "px_table", "context_excluded", 0.35, 2)


def personal_inputs(spark, sf):
    """Requests, recommendations and their affinity; each is read several times, so staged."""
    edges = stage_table(V.knowledge(spark, sf), "knowledge")
    requests = V.reco_requests(spark, sf, edges)
    top = M.commercial_top(M.scored_candidates(M.judge(requests, edges, V.commercial_data(spark, sf))))
    top = stage_table(top.withColumn("excluded", F.col("context_excluded")), "recommendations")
    own_source = top.filter(F.col("rank") == 1).select(
        F.col("request_id").alias("batch_id"),
        F.lit(100).alias("seq"),
        "customer_id",
        F.col("source_product_id").alias("product_id"),
        F.col("source_combination_id").alias("combination_id"),
    )
    asked = Z.affinity_requests(top).unionByName(own_source)
    evidence = A.evidence_from_history(
        asked.filter(A.identified()),
        V.behaviour(spark, sf),
        V.product_facts(spark, sf),
        V.compatible_products(edges),
        V.REF_TIME,
    )
    profile = A.customer_profile(V.spend_orders(spark, sf))
    table = A.affinity_table(asked, A.with_score(A.with_signals(evidence, profile, V.REF_TIME)))
    return requests, top, table


def personalised(spark, sf):
    _, top, table = personal_inputs(spark, sf)
    return X.personalise(top, table, PX)


@query(
    "personalised_score",
    """SELECT request_id, target_product_id, round(commercial_score, 9) AS commercial_score, round(com_part, 9) AS commercial_contribution,
       multiplier, round(aff_part, 9) AS affinity_contribution, boost AS preference_boost, round(penalty, 9) AS rejection_penalty,
       round(raw_score, 9) AS raw_score, round(final_score, 9) AS final_score, effective FROM px_scored""",
    "px_scored",
)
def _(spark, sf):
    rounded = ["commercial_score", "commercial_contribution", "affinity_contribution", "rejection_penalty", "raw_score", "final_score"]
    return personalised(spark, sf).select(
        "request_id",
        TARGET[0],
        *[F.round(c, 9).alias(c) for c in rounded],
        "multiplier",
        "preference_boost",
        "effective",
    )


@query(
    "personalised_excluded",
    """SELECT request_id, target_product_id, exclusion_code, round(commercial_score, 9) AS commercial_score,
       round(affinity_score, 9) AS affinity_score FROM px_personal WHERE exclusion_code IS NOT NULL""",
    "px_personal",
)
def _(spark, sf):
    return X.excluded(personalised(spark, sf)).select(
        "request_id",
        TARGET[0],
        "exclusion_code",
        F.round("commercial_score", 9).alias("commercial_score"),
        F.round("affinity_score", 9).alias("affinity_score"),
    )


@query(
    "personalised_topk",
    """SELECT request_id, CAST(personalised_rank AS INTEGER) AS personalised_rank, target_product_id, CAST(rank AS INTEGER) AS rank,
       round(final_score, 9) AS final_score FROM px_personal WHERE exclusion_code IS NULL""",
    "px_personal",
)
def _(spark, sf):
    return X.kept(personalised(spark, sf)).select(
        "request_id", "personalised_rank", TARGET[0], "rank", F.round("final_score", 9).alias("final_score")
    )


@query(
    "personalised_reasons",
    """SELECT request_id, target_product_id, array_to_string(preasons, ',') AS reasons FROM px_personal
       WHERE exclusion_code IS NULL""",
    "px_personal",
)
def _(spark, sf):
    found = X.kept(personalised(spark, sf))
    return found.select("request_id", TARGET[0], F.array_join(X.reasons(), ",").alias("reasons"))


cte(
    "px_whole_warnings",
    """
    SELECT request_id, 'PERSONALIZATION_CONTEXT_PARTIALLY_APPLIED' AS code, NULL AS product_key FROM reco_requests
      WHERE budget_currency IS NOT NULL
    UNION ALL SELECT a.batch_id, 'AFFINITY_FOR_UNKNOWN_PRODUCT_IGNORED', a.product_id || ':' FROM px_table a
      WHERE NOT EXISTS (SELECT 1 FROM reco_top t WHERE t.request_id = a.batch_id AND t.tgt = a.product_id)
    UNION ALL SELECT DISTINCT batch_id, batch_warning, NULL FROM px_table WHERE batch_warning IS NOT NULL
    """,
    "px_table",
    "reco_top",
)


@query(
    "personalised_warnings",
    """SELECT request_id, code, product_key FROM px_whole_warnings
       UNION ALL SELECT request_id, unnest(pwarnings), tgt || ':' FROM px_personal WHERE exclusion_code IS NULL""",
    "px_whole_warnings",
    "px_personal",
)
def _(spark, sf):
    requests, top, table = personal_inputs(spark, sf)
    return X.all_warnings(requests, X.personalise(top, table, PX), table)


@query(
    "candidate_checks",
    """
    SELECT 'DUPLICATED_COMMERCIAL_PRODUCT' AS "check", CAST(sum(n - 1) AS BIGINT) AS violations FROM
      (SELECT count(*) AS n FROM reco_top GROUP BY request_id, tgt)
    UNION ALL SELECT 'DUPLICATED_RANK', CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM reco_top GROUP BY request_id, rank)
    UNION ALL SELECT 'DUPLICATED_AFFINITY_PRODUCT', CAST(sum(n - 1) AS BIGINT) FROM
      (SELECT count(*) AS n FROM px_table GROUP BY batch_id, product_id)
    UNION ALL SELECT 'INCONSISTENT_COMMERCIAL_DATA', count(*) FROM reco_top WHERE tgt NOT IN (SELECT product_id FROM commercial)
    UNION ALL SELECT 'CUSTOMER_MISMATCH', count(*) FROM reco_requests r JOIN
      (SELECT DISTINCT batch_id, customer_id FROM px_table) a ON a.batch_id = r.request_id WHERE a.customer_id <> r.customer_id
    """,
    "px_table",
    "reco_top",
)
def _(spark, sf):
    requests, top, table = personal_inputs(spark, sf)
    return X.candidate_checks(top, V.commercial_data(spark, sf), table, requests)


@query(
    "personalised_stats",
    """
    SELECT p.request_id, count(*) AS commercial_candidates_received, max(received) AS affinity_entries_received,
      count(*) FILTER (has_affinity) AS candidates_with_affinity, count(*) FILTER (NOT has_affinity) AS candidates_without_affinity,
      max(ignored) AS affinity_entries_ignored,
      count(*) FILTER (exclusion_code = 'EXPLICIT_CONTEXT_EXCLUSION') AS context_exclusions,
      count(*) FILTER (exclusion_code = 'EXPLICIT_PRODUCT_REJECTION') AS rejection_exclusions,
      count(*) FILTER (exclusion_code = 'BELOW_MINIMUM_PERSONALIZED_SCORE') AS minimum_score_exclusions,
      count(*) FILTER (exclusion_code = 'RESULT_LIMIT_TRUNCATION') AS result_limit_truncations,
      count(*) FILTER (exclusion_code IS NULL) AS recommendations_returned,
      count(*) FILTER (exclusion_code IS NULL AND effective) AS with_effective_personalisation,
      count(*) FILTER (exclusion_code IS NULL AND NOT effective) AS commercial_fallbacks,
      CAST(coalesce(sum(len(pwarnings)) FILTER (exclusion_code IS NULL), 0) + max(whole) AS BIGINT) AS warnings_generated
    FROM px_personal p
    JOIN (SELECT batch_id, count(*) AS received FROM px_table GROUP BY 1) a ON a.batch_id = p.request_id
    LEFT JOIN (SELECT request_id, count(*) AS whole, count(*) FILTER (code = 'AFFINITY_FOR_UNKNOWN_PRODUCT_IGNORED') AS ignored
      FROM px_whole_warnings GROUP BY 1) w ON w.request_id = p.request_id
    GROUP BY p.request_id
    """,
    "px_personal",
    "px_whole_warnings",
)
def _(spark, sf):
    requests, top, table = personal_inputs(spark, sf)
    return X.personalised_stats(requests, X.personalise(top, table, PX), table)
