"""Queries over customer histories and over rules with a validity."""

from __future__ import annotations

from pyspark.sql import functions as F

from wicker.operators import basket as B
from wicker.operators import history as H
from wicker.operators import validity
from wicker.params import PairParams
from wicker.plans import views as V
from wicker.plans.registry import cte, query

EDGE = [*B.SOURCE, *B.TARGET]
COUNTS = ["joint_count", "source_count", "target_count", "total_transactions"]
PAIRS = PairParams()

cte("history_contents", "SELECT DISTINCT customer_key, product_id, combination_id FROM history_items", "history_items")
cte(
    "history_pairs",
    """
    SELECT *, CAST(joint_count AS DOUBLE) / total_transactions AS support, CAST(joint_count AS DOUBLE) / source_count AS confidence,
      (CAST(joint_count AS DOUBLE) / source_count) / (CAST(target_count AS DOUBLE) / total_transactions) AS lift
    FROM (
      SELECT s.product_id AS source_product_id, s.combination_id AS source_combination_id, t.product_id AS target_product_id,
        t.combination_id AS target_combination_id, count(*) AS joint_count
      FROM history_contents s JOIN history_contents t ON s.customer_key = t.customer_key AND s.product_id <> t.product_id GROUP BY ALL)
    JOIN (SELECT product_id AS source_product_id, count(*) AS source_count FROM history_contents GROUP BY 1) USING (source_product_id)
    JOIN (SELECT product_id AS target_product_id, count(*) AS target_count FROM history_contents GROUP BY 1) USING (target_product_id),
    (SELECT count(DISTINCT customer_key) AS total_transactions FROM history_contents)
    """,
    "history_contents",
)
HISTORY_SQL = f"""SELECT {", ".join(EDGE + COUNTS)}, round(support, 12) AS support, round(confidence, 9) AS confidence, round(lift, 9) AS lift
  FROM history_pairs WHERE joint_count >= 2 AND lift >= 1"""


def found(state: H.History):
    kept = B.with_thresholds(H.history_evidence(state, PAIRS.min_joint_count), PAIRS).filter(F.col("reject_code").isNull())
    return kept.select(*EDGE, *COUNTS, F.round("support", 12).alias("support"), F.round("confidence", 9).alias("confidence"), F.round("lift", 9).alias("lift"))


@query("customer_history_pairs", HISTORY_SQL, "history_pairs")
def _(spark, sf):
    """Pairs of products that the same customers bought, in whatever orders."""
    return found(H.build_history(V.history_items(spark, sf), stored=False))


@query("customer_history_update", HISTORY_SQL, "history_pairs")
def _(spark, sf):
    """The same pairs, from a state of the older orders that the newer ones are counted into."""
    items = V.history_items(spark, sf)
    newer = F.col("occurred_at") >= F.lit("1997-01-01").cast("timestamp")
    return found(H.update_history(H.build_history(items.filter(~newer), stored=False), items.filter(newer), stored=False))


cte(
    "rules",
    """
    SELECT 'r-' || CAST(id AS VARCHAR) AS rule_id, lpad(CAST(coalesce(priority, 0) AS VARCHAR), 4, '0') AS rule_version,
      CAST(product_id AS VARCHAR) AS source_product_id, CAST((product_id * 7 + group_id) % 100 + 1 AS VARCHAR) AS target_product_id,
      0.5 + priority / 10.0 AS reliability,
      valid_from, valid_to
    FROM price_rules
    """,
    "price_rules",
)
cte(
    "rule_instants",
    """SELECT DISTINCT o_orderkey AS request_id, CAST(l_partkey AS VARCHAR) AS source_product_id, o_orderdate AS moment
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)


@query(
    "rule_edges",
    """SELECT request_id, source_product_id, target_product_id, rule_id, rule_version, round(reliability, 9) AS reliability, relationship_type, evidence_kind FROM (
         SELECT i.request_id, r.*, 'manual' AS relationship_type, 'rule' AS evidence_kind,
           row_number() OVER (PARTITION BY i.request_id, r.source_product_id, r.target_product_id ORDER BY rule_version DESC, rule_id) AS place
         FROM rule_instants i JOIN rules r ON i.source_product_id = r.source_product_id AND r.source_product_id <> r.target_product_id
           AND (r.valid_from IS NULL OR r.valid_from <= i.moment) AND (r.valid_to IS NULL OR i.moment < r.valid_to))
       WHERE place = 1""",
    "rules",
    "rule_instants",
)
def _(spark, sf):
    """Rule edges valid at the time of each order, for each product in it."""
    chosen = validity.rule_edges(V.rules(spark, sf), V.rule_instants(spark, sf))
    return chosen.select(
        "request_id", "source_product_id", "target_product_id", "rule_id", "rule_version", F.round("reliability", 9).alias("reliability"), "relationship_type", "evidence_kind"
    )
