"""Queries over baskets: counts, evidence, thresholds, top-k, reliability."""

from __future__ import annotations

from pyspark.sql import functions as F

from wicker.operators import basket as B
from wicker.operators.reliability import with_reliability
from wicker.operators.sequence import next_purchases
from wicker.params import PairParams, ReliabilityParams
from wicker.plans import views as V
from wicker.plans.oracle_views import STRENGTH, pair_ctes, reliability_sql
from wicker.plans.registry import cte, query

PARAMS = PairParams(max_per_source=3)
EDGE = [*B.SOURCE, *B.TARGET]
E = ", ".join(EDGE)

pair_ctes("bi", "basket_items", V.WINDOW)
pair_ctes("mi", "mixed_items", V.NARROW)
pair_ctes("wi", "mixed_items", V.WINDOW)


def eligible(spark, sf):
    return B.gather_stored(B.basket_contents(V.basket_items(spark, sf), V.WINDOW))


def mixed_eligible(spark, sf):
    return B.gather_stored(B.basket_contents(V.mixed_items(spark, sf), V.WINDOW))


@query(
    "eligible_baskets",
    "SELECT transaction_id, product_id, combination_id, basket_size FROM mi_eligible",
    "mi_eligible",
)
def _(spark, sf):
    found = B.eligible_baskets(V.mixed_items(spark, sf), V.NARROW)
    return found.select("transaction_id", *B.ITEM, "basket_size")


@query(
    "product_counts",
    "SELECT product_id, combination_id, count(*) AS basket_count FROM wi_eligible GROUP BY ALL",
    "wi_eligible",
)
def _(spark, sf):
    return B.product_counts(mixed_eligible(spark, sf))


@query("pair_counts", f"SELECT {E}, joint_count FROM bi_pairs", "bi_pairs")
def _(spark, sf):
    return B.pair_counts(eligible(spark, sf)).select(*EDGE, "joint_count")


@query(
    "pair_evidence",
    f"""SELECT {E}, joint_count, source_count, target_count, total_transactions,
        round(support, 12) AS support, round(confidence, 9) AS confidence, round(lift, 9) AS lift
        FROM bi_evidence""",
    "bi_evidence",
)
def _(spark, sf):
    return B.evidence(eligible(spark, sf)).select(
        *EDGE,
        "joint_count",
        "source_count",
        "target_count",
        "total_transactions",
        F.round("support", 12).alias("support"),
        F.round("confidence", 9).alias("confidence"),
        F.round("lift", 9).alias("lift"),
    )


cte(
    "bi_thresholds",
    """SELECT *, CASE WHEN joint_count < 2 THEN 'JOINT_COUNT' WHEN confidence < 0.05 THEN 'CONFIDENCE'
       WHEN lift < 25 THEN 'LIFT' END AS reject_code FROM bi_evidence""",
    "bi_evidence",
)


@query("pair_thresholds", f"SELECT {E}, joint_count, reject_code FROM bi_thresholds", "bi_thresholds")
def _(spark, sf):
    p = PairParams(min_confidence=0.05, min_lift=25.0)
    return B.with_thresholds(B.evidence(eligible(spark, sf)), p).select(*EDGE, "joint_count", "reject_code")


cte(
    "bi_top",
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sk ORDER BY {STRENGTH}) AS source_rank
        FROM bi_evidence WHERE joint_count >= 2 AND lift >= 1) WHERE source_rank <= 3""",
    "bi_evidence",
)
cte("bi_passed", "SELECT * FROM bi_evidence WHERE joint_count >= 2 AND lift >= 1", "bi_evidence")


def passed(spark, sf):
    """All pairs that pass the default thresholds."""
    found = B.with_thresholds(B.evidence(eligible(spark, sf), least=PairParams().min_joint_count), PairParams())
    return found.filter(F.col("reject_code").isNull()).drop("reject_code")


def candidates(spark, sf, params: PairParams = PARAMS):
    return B.same_order_candidates(eligible(spark, sf), params)


@query(
    "top_k_per_source",
    f"""SELECT {E}, joint_count, round(confidence, 9) AS confidence, round(lift, 9) AS lift,
        CAST(source_rank AS INTEGER) AS source_rank FROM bi_top""",
    "bi_top",
)
def _(spark, sf):
    return candidates(spark, sf).select(
        *EDGE,
        "joint_count",
        F.round("confidence", 9).alias("confidence"),
        F.round("lift", 9).alias("lift"),
        "source_rank",
    )


@query(
    "reliability",
    f"SELECT {E}, joint_count, round({reliability_sql()}, 9) AS reliability FROM bi_passed",
    "bi_passed",
)
def _(spark, sf):
    return with_reliability(passed(spark, sf)).select(
        *EDGE, "joint_count", F.round("reliability", 9).alias("reliability")
    )


@query(
    "reliability_custom",
    f"SELECT {E}, round({reliability_sql(0.4, 0.3, 0.2, 0.1, 5.0)}, 9) AS reliability FROM bi_passed",
    "bi_passed",
)
def _(spark, sf):
    p = ReliabilityParams(0.4, 0.3, 0.2, 0.1, 5.0)
    return with_reliability(passed(spark, sf), p).select(
        *EDGE, F.round("reliability", 9).alias("reliability")
    )


# Variant baskets repeat pairs less often, so one joint basket is enough here.
MIXED = PairParams(min_joint_count=1, min_confidence=0.1, min_lift=30.0, max_per_source=3)
def mixed_ctes(prefix: str, window: tuple[str, str]) -> None:
    cte(
        f"{prefix}_thresholds",
        f"""SELECT *, CASE WHEN joint_count < 1 THEN 'JOINT_COUNT' WHEN confidence < 0.1 THEN 'CONFIDENCE'
           WHEN lift < 30 THEN 'LIFT' END AS reject_code FROM {prefix}_evidence""",
        f"{prefix}_evidence",
    )
    cte(
        f"{prefix}_limited",
        f"""SELECT source_product_id, source_combination_id, count(*) - 3 AS rejected
           FROM {prefix}_thresholds WHERE reject_code IS NULL GROUP BY ALL HAVING count(*) > 3""",
        f"{prefix}_thresholds",
    )
    cte(
        f"{prefix}_stats",
        f"""
        WITH h AS (SELECT transaction_id, transaction_type,
                     bool_or(occurred_at BETWEEN TIMESTAMP '{window[0]}' AND TIMESTAMP '{window[1]}') AS inside,
                     count(DISTINCT product_id || ':' || coalesce(combination_id, '')) AS n
                   FROM mixed_items GROUP BY ALL)
        SELECT count(*) AS transactions_read,
          count(*) FILTER (transaction_type = 'order') AS orders_read,
          count(*) FILTER (transaction_type = 'cart') AS carts_ignored,
          count(*) FILTER (transaction_type = 'order' AND NOT inside) AS orders_outside_data_window,
          count(*) FILTER (transaction_type = 'order' AND inside AND n < 2) AS single_product_orders_ignored,
          count(*) FILTER (transaction_type = 'order' AND inside AND n >= 2) AS orders_processed,
          (SELECT count(*) FROM {prefix}_counts) AS distinct_products_observed,
          (SELECT CAST(sum(joint_count) AS BIGINT) FROM {prefix}_pairs) AS directed_pairs_observed,
          (SELECT count(*) FROM {prefix}_pairs) AS candidates_generated,
          (SELECT count(*) FROM {prefix}_thresholds WHERE reject_code = 'JOINT_COUNT') AS candidates_rejected_by_joint_count,
          (SELECT count(*) FROM {prefix}_thresholds WHERE reject_code = 'CONFIDENCE') AS candidates_rejected_by_confidence,
          (SELECT count(*) FROM {prefix}_thresholds WHERE reject_code = 'LIFT') AS candidates_rejected_by_lift,
          (SELECT CAST(coalesce(sum(rejected), 0) AS BIGINT) FROM {prefix}_limited) AS candidates_rejected_by_source_limit,
          (SELECT count(*) FROM {prefix}_thresholds WHERE reject_code IS NULL)
            - (SELECT CAST(coalesce(sum(rejected), 0) AS BIGINT) FROM {prefix}_limited) AS candidates_accepted
        FROM h
        """,
        "mixed_items",
        f"{prefix}_thresholds",
        f"{prefix}_limited",
    )


mixed_ctes("mi", V.NARROW)
mixed_ctes("wi", V.WINDOW)


@query("cooccurrence_stats", "SELECT * FROM mi_stats", "mi_stats")
def _(spark, sf):
    return B.cooccurrence_stats(V.mixed_items(spark, sf), V.NARROW, MIXED)


@query(
    "source_limit_warnings",
    """SELECT 'SOURCE_RELATIONSHIP_LIMIT_APPLIED' AS code, source_product_id, source_combination_id,
       rejected, CAST(3 AS BIGINT) AS "limit" FROM wi_limited
       UNION ALL SELECT 'EMPTY_DATASET', NULL, NULL, NULL, NULL FROM wi_stats WHERE transactions_read = 0
       UNION ALL SELECT 'NO_ELIGIBLE_ORDERS', NULL, NULL, NULL, NULL FROM wi_stats
         WHERE transactions_read > 0 AND orders_processed = 0
       UNION ALL SELECT 'NO_RELATIONSHIPS_GENERATED', NULL, NULL, NULL, NULL FROM wi_stats
         WHERE orders_processed > 0 AND candidates_accepted = 0""",
    "wi_stats",
)
def _(spark, sf):
    return B.cooccurrence_warnings(*B.calculation(V.mixed_items(spark, sf), V.WINDOW, MIXED))


# -- further relationship types ----------------------------------------------
@query(
    "candidates_in_order",
    f"SELECT {E}, CAST(source_rank AS INTEGER) AS source_rank FROM bi_top",
    "bi_top",
)
def _(spark, sf):
    return B.in_output_order(candidates(spark, sf)).select(*EDGE, "source_rank")


cte(
    "cart_items",
    "SELECT * REPLACE (CASE transaction_type WHEN 'cart' THEN 'order' ELSE 'cart' END AS transaction_type) FROM mixed_items",
    "mixed_items",
)
pair_ctes("ci", "cart_items", V.WINDOW)


@query("same_cart_pairs", f"SELECT {E}, joint_count FROM ci_pairs", "ci_pairs")
def _(spark, sf):
    """Products that share a cart."""
    baskets = B.gather_stored(B.basket_contents(V.mixed_items(spark, sf), V.WINDOW, "cart"))
    return B.pair_counts(baskets).select(*EDGE, "joint_count")


cte(
    "history_items",
    """SELECT CAST(o_orderkey AS VARCHAR) AS transaction_id, CAST(o_custkey AS VARCHAR) AS customer_key, o_orderdate AS occurred_at,
       CAST(l_partkey AS VARCHAR) AS product_id, CAST(NULL AS VARCHAR) AS combination_id
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey IS NOT NULL""",
)


@query(
    "next_purchase",
    """
    SELECT * FROM (WITH baskets AS (SELECT customer_key, transaction_id, min(occurred_at) AS seen_at FROM history_items GROUP BY ALL),
    steps AS (SELECT transaction_id, lead(transaction_id) OVER w AS next_id,
                CAST(date_diff('day', CAST(seen_at AS DATE), CAST(lead(seen_at) OVER w AS DATE)) AS DOUBLE) AS lag_days FROM baskets
              WINDOW w AS (PARTITION BY customer_key ORDER BY seen_at, transaction_id)),
    contents AS (SELECT DISTINCT transaction_id, product_id, combination_id FROM history_items),
    sources AS (SELECT c.product_id, c.combination_id, next_id, lag_days FROM steps JOIN contents c USING (transaction_id) WHERE next_id IS NOT NULL)
    SELECT s.product_id AS source_product_id, s.combination_id AS source_combination_id, t.product_id AS target_product_id,
      t.combination_id AS target_combination_id, count(*) AS transition_count, any_value(n.source_count) AS source_count,
      round(CAST(count(*) AS DOUBLE) / any_value(n.source_count), 9) AS transition_probability, median(lag_days) AS median_lag_days
    FROM sources s JOIN contents t ON t.transaction_id = s.next_id
      JOIN (SELECT product_id, count(*) AS source_count FROM sources GROUP BY 1) n ON n.product_id = s.product_id
    GROUP BY ALL)
    """,
    "history_items",
)
def _(spark, sf):
    """Products in the next basket of the same customer."""
    found = next_purchases(V.history_items(spark, sf))
    return found.withColumn("transition_probability", F.round("transition_probability", 9))
