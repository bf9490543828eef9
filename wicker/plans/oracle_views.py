"""Engine inputs derived from the test tables, in SQL (see `views`)."""

from wicker.plans.registry import cte

cte(
    "basket_items",
    """
    SELECT CAST(o_orderkey AS VARCHAR) AS transaction_id, 'order' AS transaction_type,
           o_orderdate AS occurred_at, CAST(l_partkey AS VARCHAR) AS product_id,
           CAST(NULL AS VARCHAR) AS combination_id
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    """,
)
cte(
    "mixed_items",
    """
    SELECT CAST(o_orderkey AS VARCHAR) AS transaction_id,
           CASE WHEN o_orderpriority = '5-LOW' THEN 'cart' ELSE 'order' END AS transaction_type,
           o_orderdate AS occurred_at, CAST(l_partkey AS VARCHAR) AS product_id,
           CASE WHEN l_suppkey % 3 <> 0 THEN CAST(l_suppkey % 3 AS VARCHAR) END AS combination_id
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    """,
)


def pair_ctes(prefix: str, items: str, window: tuple[str, str]) -> None:
    """Co-occurrence of one item view, step by step."""
    cte(
        f"{prefix}_contents",
        f"""
        SELECT DISTINCT transaction_id, product_id, combination_id,
               product_id || ':' || coalesce(combination_id, '') AS k
        FROM {items} WHERE transaction_type = 'order'
          AND occurred_at BETWEEN TIMESTAMP '{window[0]}' AND TIMESTAMP '{window[1]}'
        """,
        items,
    )
    cte(
        f"{prefix}_eligible",
        f"""
        SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY transaction_id) AS basket_size
                       FROM {prefix}_contents) WHERE basket_size >= 2
        """,
        f"{prefix}_contents",
    )
    cte(
        f"{prefix}_counts",
        f"SELECT k, count(*) AS basket_count FROM {prefix}_eligible GROUP BY k",
        f"{prefix}_eligible",
    )
    cte(
        f"{prefix}_pairs",
        f"""
        SELECT s.product_id AS source_product_id, s.combination_id AS source_combination_id,
               t.product_id AS target_product_id, t.combination_id AS target_combination_id,
               s.k AS sk, t.k AS tk, count(*) AS joint_count
        FROM {prefix}_eligible s JOIN {prefix}_eligible t
          ON s.transaction_id = t.transaction_id AND s.k <> t.k
        GROUP BY ALL
        """,
        f"{prefix}_eligible",
    )
    cte(
        f"{prefix}_evidence",
        f"""
        SELECT *, CAST(joint_count AS DOUBLE) / total_transactions AS support,
               CAST(joint_count AS DOUBLE) / source_count AS confidence,
               (CAST(joint_count AS DOUBLE) / source_count)
                 / (CAST(target_count AS DOUBLE) / total_transactions) AS lift
        FROM (SELECT p.*, a.basket_count AS source_count, b.basket_count AS target_count,
                     (SELECT count(DISTINCT transaction_id) FROM {prefix}_eligible) AS total_transactions
              FROM {prefix}_pairs p JOIN {prefix}_counts a ON a.k = p.sk
              JOIN {prefix}_counts b ON b.k = p.tk)
        """,
        f"{prefix}_pairs",
        f"{prefix}_counts",
    )


STRENGTH = """confidence DESC, lift DESC, joint_count DESC,
              target_product_id ASC, target_combination_id ASC NULLS FIRST"""
RELIABILITY = """greatest(0.0, least(1.0, {c} * confidence
    + {l} * CASE WHEN lift <= 1 THEN 0.0 ELSE 1 - 1.0 / lift END
    + {s} * support
    + {j} * CASE WHEN joint_count <= 0 THEN 0.0 ELSE 1 - exp(-joint_count / {scale}) END))"""


def reliability_sql(c=0.5, l=0.25, s=0.1, j=0.15, scale=10.0) -> str:
    # DuckDB reads 0.5 as DECIMAL; the products must be doubles
    cast = {k: f"CAST({v} AS DOUBLE)" for k, v in dict(c=c, l=l, s=s, j=j, scale=scale).items()}
    return RELIABILITY.format(**cast)

BAD_QUANTITY = """CASE WHEN l_partkey % 83 = 0 THEN 0.0 WHEN l_partkey % 79 = 0 THEN l_quantity + 0.5
                  ELSE l_quantity END"""
cte(
    "order_view",
    f"""
    SELECT CAST(o_orderkey AS VARCHAR) AS order_id, o_orderdate AS occurred_at, o_orderstatus AS order_state,
      CASE WHEN l_partkey % 61 <> 0 THEN l_linenumber END AS line_id,
      CASE WHEN l_partkey % 59 = 0 THEN '' ELSE CAST(l_partkey AS VARCHAR) END AS product_id,
      {BAD_QUANTITY} AS quantity, l_partkey, l_suppkey, l_quantity, l_shipdate
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey
    """,
)
COPIES = "unnest(CASE WHEN {} % 50 = 0 THEN [0, 1] ELSE [0] END) AS copy"
cte(
    "raw_headers",
    f"""
    SELECT o_orderkey * 2 + copy AS seq,
      CASE WHEN o_orderkey % 101 = 0 THEN ' ' ELSE CAST(o_orderkey AS VARCHAR) END AS transaction_id,
      CASE WHEN o_orderkey % 103 = 0 THEN 'refund' WHEN o_orderkey % 150 = 0 AND copy = 1 THEN 'cart'
           WHEN o_orderpriority = '5-LOW' THEN 'cart' ELSE 'order' END AS transaction_type,
      CASE WHEN o_orderkey % 107 = 0 THEN NULL
           WHEN o_orderkey % 7 = 0 THEN date_trunc('day', o_orderdate) + INTERVAL 4 HOUR
           ELSE date_trunc('day', o_orderdate) END AS instant,
      CASE WHEN o_orderkey % 250 = 0 AND copy = 0 THEN 'X' ELSE o_orderstatus END AS status,
      CASE WHEN o_custkey % 10 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS customer_key,
      o_orderkey IN (SELECT l_orderkey FROM lineitem) OR o_orderkey % 2 = 1 AS has_lines,
      CASE WHEN o_orderkey % 19 <> 0 THEN 'order:' || o_orderkey END AS source_reference
    FROM (SELECT *, {COPIES.format("o_orderkey")} FROM orders)
    """,
)
cte(
    "raw_lines",
    f"""
    SELECT l_orderkey * 2 + copy AS seq,
      lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || lpad(CAST(l_partkey AS VARCHAR), 12, '0')
        || lpad(CAST(l_suppkey AS VARCHAR), 10, '0') || lpad(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), 4, '0')
        || strftime(l_shipdate, '%Y%m%d') AS line_seq,
      l_linenumber || '-' || l_partkey || '-' || l_suppkey AS line_id,
      CASE WHEN l_partkey % 97 = 0 THEN '' ELSE CAST(l_partkey AS VARCHAR) END AS product_id,
      CASE WHEN l_suppkey % 3 = 0 THEN NULL WHEN l_partkey % 89 = 0 THEN ' '
           ELSE CAST(l_suppkey % 3 AS VARCHAR) END AS combination_id,
      {BAD_QUANTITY} AS quantity, l_returnflag AS line_status
    FROM (SELECT *, {COPIES.format("l_orderkey")} FROM lineitem)
    """,
)

EDGE_COLUMNS = """source_product_id, source_combination_id, target_product_id, target_combination_id,
  relationship_type, evidence_kind, joint_count, source_count, target_count, total_transactions, support,
  confidence, lift, transition_count, transition_probability, median_lag_days, rule_id, rule_version,
  reliability, window_from, window_to, model_version"""


def edge_ctes(window: tuple[str, str], model: str) -> None:
    cte(
        "edges",
        f"""
        SELECT (CAST(source_product_id AS BIGINT) * 10000000 + CAST(target_product_id AS BIGINT)) * 2 AS seq,
          source_product_id, source_combination_id, target_product_id, target_combination_id,
          'same_order' AS relationship_type, 'co_occurrence' AS evidence_kind,
          joint_count, source_count, target_count, total_transactions, support, confidence, lift,
          CAST(NULL AS BIGINT) AS transition_count, CAST(NULL AS DOUBLE) AS transition_probability,
          CAST(NULL AS DOUBLE) AS median_lag_days, CAST(NULL AS VARCHAR) AS rule_id,
          CAST(NULL AS VARCHAR) AS rule_version, {reliability_sql()} AS reliability,
          TIMESTAMP '{window[0]}' AS window_from, TIMESTAMP '{window[1]}' AS window_to, '{model}' AS model_version
        FROM (SELECT *, row_number() OVER (PARTITION BY sk ORDER BY {STRENGTH}) AS rn
              FROM bi_evidence WHERE joint_count >= 2) WHERE rn <= 50
        """,
        "bi_evidence",
    )
    cte(
        "dirty_edges",
        """
        SELECT seq + copy AS seq,
          CASE WHEN m = 0 THEN ' ' ELSE source_product_id END AS source_product_id, source_combination_id,
          CASE WHEN m = 1 THEN '' WHEN m = 2 THEN source_product_id ELSE target_product_id END AS target_product_id,
          target_combination_id,
          CASE m WHEN 3 THEN 'bundle' WHEN 19 THEN 'manual' WHEN 20 THEN 'next_purchase' WHEN 21 THEN 'manual'
            ELSE relationship_type END AS relationship_type,
          CASE m WHEN 4 THEN 'rule' WHEN 19 THEN 'rule' WHEN 20 THEN 'transition' WHEN 21 THEN 'rule'
            ELSE evidence_kind END AS evidence_kind,
          CASE WHEN m = 11 THEN 0 WHEN m = 13 THEN source_count + 1 WHEN m BETWEEN 19 AND 21 THEN NULL
            ELSE joint_count END AS joint_count,
          CASE WHEN m = 12 THEN 0 WHEN m BETWEEN 19 AND 21 THEN NULL ELSE source_count END AS source_count,
          CASE WHEN m BETWEEN 19 AND 21 THEN NULL ELSE target_count END AS target_count,
          CASE WHEN m BETWEEN 19 AND 21 THEN NULL ELSE total_transactions END AS total_transactions,
          CASE WHEN m = 8 THEN -0.1::DOUBLE WHEN m = 14 THEN support + 1e-6::DOUBLE WHEN m BETWEEN 19 AND 21 THEN NULL
            ELSE support END AS support,
          CASE WHEN m = 9 THEN 1.2::DOUBLE WHEN m = 15 THEN confidence + 1e-6::DOUBLE
            WHEN m BETWEEN 19 AND 21 THEN NULL ELSE confidence END AS confidence,
          CASE WHEN m = 10 THEN -1.0::DOUBLE WHEN m = 16 THEN lift + 1e-6::DOUBLE
            WHEN m BETWEEN 19 AND 21 THEN NULL ELSE lift END AS lift,
          CASE WHEN m = 20 THEN 3 ELSE transition_count END AS transition_count,
          CASE WHEN m = 20 THEN 0.5::DOUBLE ELSE transition_probability END AS transition_probability, median_lag_days,
          CASE WHEN m = 21 THEN 'r1' ELSE rule_id END AS rule_id,
          CASE WHEN m = 21 THEN '1' ELSE rule_version END AS rule_version,
          CASE WHEN m = 7 THEN 1.5::DOUBLE WHEN m = 17 THEN 'NaN'::DOUBLE ELSE reliability END AS reliability,
          CASE WHEN m = 5 THEN TIMESTAMP '2002-06-01' ELSE window_from END AS window_from, window_to,
          CASE WHEN m = 6 THEN ' ' ELSE model_version END AS model_version
        FROM (SELECT *, unnest(CASE WHEN m = 18 THEN [0, 1] ELSE [0] END) AS copy FROM
          (SELECT *, (CAST(source_product_id AS BIGINT) * 31 + CAST(target_product_id AS BIGINT)) % 31 AS m FROM edges))
        """,
        "edges",
    )
    cte(
        "validated",
        """
        WITH own AS (SELECT *, CASE WHEN isnan(reliability) THEN 'NON_SERIALIZABLE_RELATIONSHIP'
            WHEN trim(source_product_id) = '' THEN 'INVALID_SOURCE_PRODUCT'
            WHEN trim(target_product_id) = '' THEN 'INVALID_TARGET_PRODUCT'
            WHEN source_product_id = target_product_id THEN 'SELF_RELATIONSHIP'
            WHEN relationship_type = 'bundle' THEN 'UNSUPPORTED_RELATIONSHIP_TYPE'
            WHEN NOT (evidence_kind = 'co_occurrence' AND relationship_type = 'same_order'
              OR evidence_kind = 'transition' AND relationship_type = 'next_purchase'
              OR evidence_kind = 'rule' AND relationship_type = 'manual') THEN 'EVIDENCE_TYPE_MISMATCH'
            WHEN window_from > window_to THEN 'INVALID_EVIDENCE_WINDOW'
            WHEN trim(model_version) = '' THEN 'INVALID_MODEL_VERSION'
            WHEN reliability NOT BETWEEN 0 AND 1 THEN 'INVALID_RELIABILITY'
            WHEN support NOT BETWEEN 0 AND 1 THEN 'INVALID_SUPPORT'
            WHEN confidence NOT BETWEEN 0 AND 1 THEN 'INVALID_CONFIDENCE'
            WHEN lift < 0 THEN 'INVALID_LIFT'
            WHEN joint_count = 0 THEN 'INVALID_JOINT_COUNT'
            WHEN source_count <= 0 THEN 'INVALID_EVIDENCE_COUNTS'
            WHEN joint_count > source_count OR joint_count > target_count THEN 'INCONSISTENT_EVIDENCE_COUNTS'
            WHEN abs(support - joint_count::DOUBLE / total_transactions) > 1e-12 THEN 'INCONSISTENT_SUPPORT'
            WHEN abs(confidence - joint_count::DOUBLE / source_count) > 1e-12 THEN 'INCONSISTENT_CONFIDENCE'
            WHEN abs(lift - confidence / (target_count::DOUBLE / total_transactions)) > 1e-12 THEN 'INCONSISTENT_LIFT'
            WHEN lift <= 1 THEN 'NON_POSITIVE_ASSOCIATION'
            WHEN reliability < 0.3 THEN 'RELIABILITY_BELOW_MINIMUM' END AS own_code FROM dirty_edges)
        SELECT *, CASE WHEN own_code IS NOT NULL THEN own_code
          WHEN EXISTS (SELECT 1 FROM own e WHERE e.own_code IS NULL AND e.seq < own.seq
            AND e.source_product_id = own.source_product_id AND e.target_product_id = own.target_product_id
            AND e.relationship_type = own.relationship_type AND (e.evidence_kind <> 'rule' OR e.rule_id IS NOT NULL))
            THEN 'DUPLICATE_RELATIONSHIP'
          WHEN evidence_kind = 'rule' AND rule_id IS NULL THEN 'NON_SERIALIZABLE_RELATIONSHIP' END AS reject_code
        FROM own
        """,
        "dirty_edges",
    )
    cte("valid_edges", "SELECT * FROM edges WHERE lift > 1 AND reliability >= 0.3", "edges")
    cte(
        "knowledge",
        f"""
        SELECT {EDGE_COLUMNS} FROM valid_edges UNION ALL
        SELECT source_product_id, source_combination_id, target_product_id, target_combination_id, 'manual', 'rule',
          NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'r-' || source_product_id, '1',
          CASE WHEN (CAST(source_product_id AS BIGINT) + CAST(target_product_id AS BIGINT)) % 12 = 0
            THEN 0.9::DOUBLE ELSE 0.25::DOUBLE END, window_from, window_to, model_version
        FROM valid_edges WHERE (CAST(source_product_id AS BIGINT) + CAST(target_product_id AS BIGINT)) % 6 = 0
        """,
        "valid_edges",
    )


cte(
    "source_requests",
    """
    SELECT p_partkey AS request_id, CAST(p_partkey AS VARCHAR) AS source_product_id,
      CASE p_partkey % 4 WHEN 0 THEN ['same_order'] WHEN 1 THEN ['manual', 'same_cart'] END AS relationship_types,
      CASE WHEN p_partkey % 3 <> 0 THEN 1 + p_partkey % 2 END AS lim FROM part
    """,
)

# -- catalogue ---------------------------------------------------------------
cte(
    "cat_product",
    """
    SELECT p_partkey AS product_id, CASE WHEN p_partkey % 9 <> 0 THEN 'REF-' || p_partkey END AS reference,
      p_type AS category_id, CASE WHEN p_partkey % 29 <> 0 THEN p_partkey % 17 <> 0 END AS active,
      CASE WHEN p_partkey % 31 <> 0 THEN p_partkey % 13 <> 0 END AS available_for_order,
      CAST(CASE WHEN p_partkey % 37 = 0 THEN NULL WHEN p_partkey % 43 = 0 THEN -5.0 ELSE p_retailprice END
        AS DECIMAL(20,6)) AS price,
      p_name AS name, p_brand || ' & ' || p_type AS short_description, 'Size ' || p_size AS long_description,
      CASE WHEN p_partkey % 5 = 0 THEN CAST(CAST(p_retailprice AS DECIMAL(20,6)) + 10 AS DECIMAL(20,6)) END AS shop_price,
      CASE WHEN p_partkey % 5 = 0 AND p_partkey % 10 <> 0 THEN p_partkey % 15 <> 0 END AS shop_orderable,
      CASE WHEN p_type <> 'ECONOMY' THEN 'Cat ' || p_type END AS category
    FROM part
    """,
)
cte(
    "cat_variant",
    """
    SELECT CASE WHEN lp % 4 = 0 THEN -1 - lp ELSE lp END AS product_id, lp * 10 + v + 1 AS combination_id,
      CASE WHEN v <> 2 THEN 'REF-' || lp || '-' || v END AS reference,
      CAST(CASE v WHEN 0 THEN 0.0 WHEN 1 THEN 2.5 ELSE 3.0 END AS DECIMAL(20,6)) AS impact_net,
      CASE WHEN lp % 7 <> 0 THEN CAST(v >= lp % 3 AS INTEGER) END AS default_on, v, lp
    FROM (SELECT DISTINCT l_partkey AS lp, l_suppkey % 3 AS v FROM lineitem)
    """,
)
cte(
    "cat_stock",
    """
    SELECT p_partkey AS product_id, CAST(0 AS BIGINT) AS combination_id,
      CASE WHEN p_partkey % 19 <> 0 THEN (p_partkey * 7) % 50 - 5 END AS physical_quantity
    FROM part WHERE p_partkey % 11 <> 0
    UNION ALL SELECT product_id, CAST(combination_id AS BIGINT), combination_id % 13 - 2 FROM cat_variant WHERE combination_id % 7 <> 0
    """,
    "cat_variant",
)
cte(
    "cat_attributes",
    """
    SELECT combination_id, 'Color' AS "group", 'Value ' || (1 + v) AS value FROM cat_variant
    UNION ALL SELECT combination_id, 'Talla', 'Value ' || (10 + lp % 5) FROM cat_variant
    """,
    "cat_variant",
)
cte(
    "cat_labels",
    """SELECT combination_id, string_agg("group" || ': ' || value, ' | ' ORDER BY "group", value) AS label
       FROM cat_attributes GROUP BY combination_id""",
    "cat_attributes",
)
cte(
    "cat_requests",
    """
    SELECT p_partkey AS request_id, p_partkey AS product_id,
      CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_partkey * 10 + p_size % 4 END AS combination_id,
      CAST(1 + p_size AS BIGINT) AS quantity, 1 AS shop_id, 1 AS currency_id, 1 AS country_id, p_partkey % 3 AS group_id,
      p_partkey % 5 AS customer_id FROM part
    """,
)
cte(
    "price_rules",
    """
    SELECT (l_orderkey * 100000 + l_partkey) * 1000 + l_suppkey AS id, l_partkey AS product_id,
      CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE l_partkey * 10 + l_suppkey % 3 + 1 END AS combination_id,
      CASE l_linenumber WHEN 3 THEN 1 WHEN 5 THEN 2 ELSE 0 END AS shop_id,
      CASE WHEN l_suppkey % 4 = 1 THEN 1 ELSE 0 END AS currency_id, 0 AS country_id, l_suppkey % 3 AS group_id,
      CASE WHEN l_linenumber = 6 THEN l_partkey % 5 ELSE 0 END AS customer_id,
      CASE WHEN l_suppkey % 25 = 0 THEN 9 ELSE 0 END AS cart_id,
      CAST(CASE WHEN l_returnflag = 'N' THEN l_extendedprice ELSE -1.0 END AS DECIMAL(20,6)) AS price,
      CAST(l_quantity AS BIGINT) AS from_quantity,
      CAST(CASE WHEN l_suppkey % 33 = 0 AND l_returnflag = 'R' THEN 1.5 WHEN l_suppkey % 35 = 0 THEN -0.1
        WHEN l_returnflag = 'A' THEN l_discount * 1000 WHEN l_returnflag = 'R' THEN l_discount
        WHEN l_suppkey % 37 = 0 THEN 0.1 ELSE 0.0 END AS DECIMAL(20,6)) AS reduction,
      l_linenumber % 2 AS reduction_tax,
      CASE WHEN l_returnflag = 'R' THEN 'percentage' WHEN l_returnflag = 'A' THEN 'amount'
        WHEN l_suppkey % 37 = 0 THEN 'gift' ELSE 'amount' END AS reduction_type,
      CASE WHEN l_suppkey % 10 > 1 AND NOT (l_suppkey % 10 = 2 AND l_linenumber = 4) THEN l_shipdate END AS valid_from,
      l_suppkey % 10 = 2 AND l_linenumber = 4 AS unreadable,
      CASE WHEN l_suppkey % 10 <> 3 THEN l_shipdate + INTERVAL 180 DAY END AS valid_to,
      CASE WHEN l_linenumber <> 4 THEN l_linenumber % 3 END AS priority
    FROM lineitem
    """,
)


def rule_ctes(prefix: str, requests: str, as_of: str) -> None:
    """Scoped rules and the catalogue selection for one request view (needs request_id)."""
    cte(
        f"{prefix}_scoped",
        f"""
        SELECT q.*, r.id AS rule_id, r.combination_id AS r_combination, r.shop_id AS r_shop, r.currency_id AS r_currency,
          r.country_id AS r_country, r.group_id AS r_group, r.customer_id AS r_customer, r.price AS rule_price,
          r.from_quantity, r.reduction, r.reduction_tax, r.reduction_type, r.valid_from, r.valid_to, r.unreadable,
          r.priority,
          NOT r.unreadable AND coalesce(r.valid_from <= TIMESTAMP '{as_of}', true)
            AND coalesce(r.valid_to >= TIMESTAMP '{as_of}', true) AS valid
        FROM {requests} q JOIN price_rules r ON r.product_id = q.product_id AND r.cart_id = 0
          AND r.from_quantity <= q.quantity AND r.combination_id IN (0, q.combination_id) AND r.shop_id IN (0, q.shop_id)
          AND r.currency_id IN (0, q.currency_id) AND r.country_id IN (0, q.country_id)
          AND r.group_id IN (0, q.group_id) AND r.customer_id IN (0, q.customer_id)
        """,
        requests,
        "price_rules",
    )
    cte(
        f"{prefix}_selected",
        f"""
        SELECT *, lead(keys) OVER w = keys AS tied, lead(rule_id) OVER w AS next_id, row_number() OVER w AS place FROM
          (SELECT *, [CAST(r_combination = combination_id AND combination_id > 0 AS BIGINT),
               CAST(r_shop = shop_id AS BIGINT), from_quantity,
               CAST(r_currency = currency_id AS BIGINT) + CAST(r_country = country_id AS BIGINT)
                 + CAST(r_group = group_id AS BIGINT) + CAST(r_customer = customer_id AS BIGINT),
               coalesce(epoch_us(valid_from), 0)] AS keys FROM {prefix}_scoped WHERE valid)
        WINDOW w AS (PARTITION BY request_id ORDER BY keys DESC, rule_id DESC)
        """,
        f"{prefix}_scoped",
    )
    cte(f"{prefix}_best", f"SELECT * FROM {prefix}_selected WHERE place = 1", f"{prefix}_selected")


PRICE_SQL = """
    SELECT *, CASE WHEN NOT priced THEN NULL
        WHEN fits THEN CAST(round(CAST(base_gross AS DECIMAL(15,0)) * (1 - CAST(reduction AS DECIMAL(12,6))), 0) AS BIGINT)
        WHEN amount THEN greatest(base_gross - cut, 0) ELSE base_gross END AS final_gross,
      CASE WHEN priced AND fits THEN 'percentage' WHEN priced AND amount THEN 'amount' END AS discount_type,
      CASE WHEN priced AND fits THEN CAST(reduction AS DOUBLE) WHEN priced AND amount THEN CAST(cut AS DOUBLE) END AS discount_value,
      CASE WHEN priced THEN rule_id END AS specific_price_id,
      list_filter([CASE WHEN NOT priced THEN 'CATALOG_INVALID_BASE_PRICE' END,
        CASE WHEN NOT priced THEN 'CATALOG_PRICE_UNAVAILABLE' END,
        CASE WHEN priced AND (pct AND reduction > 1 OR reduction < 0) THEN 'SPECIFIC_PRICE_INVALID_REDUCTION' END,
        CASE WHEN priced AND amount AND cut > base_gross THEN 'SPECIFIC_PRICE_EXCEEDS_BASE_PRICE' END,
        CASE WHEN priced AND reduction > 0 AND reduction_type = 'gift' THEN 'SPECIFIC_PRICE_UNSUPPORTED_REDUCTION_TYPE' END],
        lambda x: x IS NOT NULL) AS price_warnings
    FROM (SELECT *, base_net IS NOT NULL AND base_net >= 0 AS priced,
        coalesce(reduction > 0 AND reduction_type = 'percentage', false) AS pct,
        coalesce(reduction > 0 AND reduction_type = 'percentage' AND reduction <= 1, false) AS fits,
        coalesce(reduction > 0 AND reduction_type = 'amount', false) AS amount,
        CAST(round(reduction, 0) AS BIGINT) AS cut,
        CASE WHEN base_net >= 0 THEN CAST(round(greatest(CAST(CASE WHEN rule_price >= 0 THEN rule_price + impact_net
          ELSE base_net END AS DECIMAL(18,6)), 0) * 1.19, 0) AS BIGINT) END AS base_gross
      FROM (SELECT *, base_price_net + impact_net AS base_net FROM {source}))
"""
STATUS_SQL = """CASE WHEN active = false THEN 'inactive' WHEN active IS NULL OR available_for_order IS NULL THEN 'unknown'
  WHEN NOT available_for_order THEN 'unavailable_for_order' WHEN stock_quantity IS NULL THEN 'unknown'
  WHEN stock_quantity > 0 THEN 'available' ELSE 'out_of_stock' END"""


def assembled_cte(name: str, requests: str, *extra: str) -> None:
    cte(
        name,
        f"""
        SELECT q.*, p.name, p.reference AS product_reference, v.reference AS combination_reference,
          p.short_description AS description, p.category, p.active,
          coalesce(p.shop_orderable, p.available_for_order) AS available_for_order,
          coalesce(p.shop_price, p.price) AS base_price_net,
          CASE WHEN q.combination_id = 0 THEN CAST(0 AS DECIMAL(20,6)) ELSE v.impact_net END AS impact_net,
          CASE WHEN s.product_id IS NOT NULL THEN CAST(coalesce(s.physical_quantity, 0) AS DOUBLE) END AS stock_quantity
        FROM {requests} q JOIN cat_product p ON p.product_id = q.product_id
        LEFT JOIN cat_variant v ON v.product_id = q.product_id AND v.combination_id = q.combination_id
        LEFT JOIN cat_stock s ON s.product_id = q.product_id AND s.combination_id = q.combination_id
        WHERE q.combination_id = 0 OR v.combination_id IS NOT NULL
        """,
        requests,
        "cat_product",
        "cat_variant",
        "cat_stock",
        *extra,
    )


assembled_cte("assembled", "cat_requests")
cte(
    "truth_references",
    """
    SELECT DISTINCT ref_product, ref_combination, CAST(ref_product AS BIGINT) AS product_id,
      coalesce(CAST(ref_combination AS BIGINT), 0) AS combination_id,
      ref_product || ':' || coalesce(ref_combination, '') AS request_id,
      1 AS shop_id, 1 AS currency_id, 1 AS country_id, 1 AS group_id, 0 AS customer_id, 10 AS quantity
    FROM (SELECT CAST(p_partkey AS VARCHAR) AS ref_product, NULL AS ref_combination FROM part
          WHERE p_partkey % 41 <> 0 AND p_partkey > 0
          UNION ALL SELECT CAST(p_partkey AS VARCHAR), CASE p_size % 4 WHEN 2 THEN CAST(p_partkey * 10 + 1 AS VARCHAR)
            WHEN 3 THEN CAST(p_partkey * 10 + 2 AS VARCHAR) END FROM part WHERE p_partkey % 41 <> 0 AND p_partkey > 0)
    """,
)
assembled_cte("truth_assembled", "truth_references")

# -- recommendation ----------------------------------------------------------
cte(
    "commercial",
    """
    SELECT CASE WHEN p_partkey % 23 = 0 THEN 'x' || p_partkey ELSE CAST(p_partkey AS VARCHAR) END AS product_id,
      p_partkey % 11 <> 0 AS available, p_partkey % 13 <> 0 AS sellable, p_partkey % 17 <> 0 AS active,
      CASE p_partkey % 5 WHEN 0 THEN 'low_stock' WHEN 1 THEN 'out_of_stock' WHEN 2 THEN 'unknown' ELSE 'in_stock' END
        AS stock_status,
      CASE WHEN p_partkey % 9 = 0 THEN 'EUR' ELSE 'CLP' END AS currency,
      CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS amount,
      CASE p_size % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'unknown' END AS margin_signal,
      CASE p_size % 6 WHEN 0 THEN 'incompatible' WHEN 1 THEN 'unknown' ELSE 'compatible' END AS compatibility
    FROM part
    """,
)


def request_cte(name: str, edges: str) -> None:
    cte(
        name,
        f"""
        SELECT p_partkey AS request_id, CAST(p_partkey AS VARCHAR) AS src,
          CASE WHEN p_partkey % 5 = 0 THEN lo END AS excluded, CASE WHEN p_partkey % 3 = 0 THEN hi END AS cart,
          CASE WHEN p_partkey % 2 = 0 THEN lo END AS purchased, CASE WHEN p_partkey % 2 = 1 THEN lo END AS preferred,
          CASE WHEN p_partkey % 4 = 0 THEN hi END AS context_excluded, p_partkey % 2 = 0 AS include_out_of_stock,
          p_partkey % 4 = 1 AS in_stock_only, CASE WHEN p_partkey % 3 <> 0 THEN 'CLP' END AS budget_currency,
          CASE WHEN p_partkey % 3 <> 0 THEN 900::DOUBLE + p_size * 4 END AS budget_max, 1 + p_partkey % 3 AS lim,
          CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 7 = 3 THEN 'new-' || p_partkey
            ELSE CAST(p_partkey % 149 + 1 AS VARCHAR) END AS customer_id
        FROM part LEFT JOIN (SELECT source_product_id, min(target_product_id) AS lo, max(target_product_id) AS hi
          FROM {edges} GROUP BY 1) ON source_product_id = CAST(p_partkey AS VARCHAR)
        """,
        edges,
    )


def commercial_ctes(prefix: str, requests: str, edges: str, data: str, pool: str) -> None:
    """Judged, scored and ranked candidates; `pool` is the limit expression."""
    cte(
        f"{prefix}_judged",
        f"""
        SELECT *, out AND NOT include_out_of_stock AS drop_out, CASE WHEN dup > 1 THEN 'DUPLICATE_TARGET'
          WHEN NOT has_data THEN 'MISSING_COMMERCIAL_DATA' WHEN tgt = src THEN 'SOURCE_PRODUCT'
          WHEN tgt = excluded THEN 'EXPLICITLY_EXCLUDED' WHEN tgt = cart THEN 'ALREADY_IN_CART'
          WHEN NOT active THEN 'INACTIVE' WHEN NOT sellable THEN 'NOT_SELLABLE'
          WHEN out AND NOT include_out_of_stock THEN 'OUT_OF_STOCK' WHEN compatibility = 'incompatible' THEN 'INCOMPATIBLE'
          WHEN currency = budget_currency AND amount > budget_max THEN 'ABOVE_BUDGET' END AS reject_code
        FROM (SELECT r.*, k.* EXCLUDE (source_product_id, source_combination_id), k.target_product_id AS tgt,
            coalesce(lift, 0) AS z_lift, coalesce(confidence, 0) AS z_conf, coalesce(support, 0) AS z_sup,
            coalesce(joint_count, 0) AS z_joint,
            row_number() OVER (PARTITION BY r.request_id, k.target_product_id ORDER BY reliability DESC,
              coalesce(lift, 0) DESC, coalesce(confidence, 0) DESC, coalesce(support, 0) DESC, coalesce(joint_count, 0) DESC,
              relationship_type) AS dup,
            c.product_id IS NOT NULL AS has_data, c.* EXCLUDE (product_id),
            c.stock_status = 'out_of_stock' OR NOT c.available AS out
          FROM {requests} r JOIN {edges} k ON k.source_product_id = r.src
          LEFT JOIN {data} c ON c.product_id = k.target_product_id)
        """,
        requests,
        edges,
        data,
    )
    cte(
        f"{prefix}_scored",
        f"""
        SELECT *, greatest(0::DOUBLE, least(100::DOUBLE, s_rel + s_avail + s_comp + s_margin + s_pen)) AS total FROM
        (SELECT *, reliability * 45 + z_conf * 20 + greatest(0::DOUBLE, least(1::DOUBLE, (z_lift - 1) / 4)) * 15
            + greatest(0::DOUBLE, least(1::DOUBLE, z_sup / 0.1::DOUBLE)) * 10 AS s_rel,
          CASE stock_status WHEN 'in_stock' THEN 5 WHEN 'low_stock' THEN 2 WHEN 'out_of_stock' THEN -15 ELSE 0 END::DOUBLE AS s_avail,
          CASE WHEN compatibility = 'compatible' THEN 5 ELSE 0 END::DOUBLE AS s_comp,
          CASE margin_signal WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 0 END::DOUBLE AS s_margin,
          (CASE WHEN out THEN -15 ELSE 0 END + CASE WHEN budget_currency IS NOT NULL AND amount IS NULL THEN -2 ELSE 0 END
            + CASE WHEN amount IS NOT NULL AND currency <> budget_currency THEN -2 ELSE 0 END)::DOUBLE AS s_pen,
          list_filter([CASE WHEN tgt = purchased THEN 'ALREADY_PURCHASED' END, CASE WHEN out THEN 'OUT_OF_STOCK_INCLUDED' END,
            CASE WHEN NOT out AND stock_status = 'low_stock' THEN 'LOW_STOCK' END,
            CASE WHEN NOT out AND stock_status = 'unknown' THEN 'UNKNOWN_STOCK' END,
            CASE WHEN compatibility = 'unknown' THEN 'UNKNOWN_COMPATIBILITY' END,
            CASE WHEN budget_currency IS NOT NULL AND amount IS NULL THEN 'PRICE_UNAVAILABLE' END,
            CASE WHEN amount IS NOT NULL AND currency <> budget_currency THEN 'CURRENCY_MISMATCH' END],
            lambda x: x IS NOT NULL) AS warnings,
          list_filter([CASE WHEN NOT out AND stock_status = 'low_stock' THEN 'LOW_STOCK' END,
            CASE WHEN NOT out AND stock_status NOT IN ('low_stock', 'unknown') THEN 'AVAILABLE' END,
            CASE WHEN compatibility = 'compatible' THEN 'COMPATIBLE' END,
            CASE WHEN amount IS NOT NULL AND currency = budget_currency THEN 'WITHIN_BUDGET' END,
            CASE WHEN reliability >= 0.7 THEN 'STRONG_RELATIONSHIP' END,
            CASE WHEN evidence_kind = 'co_occurrence' AND confidence >= 0.5 THEN 'HIGH_CONFIDENCE' END,
            CASE WHEN evidence_kind = 'co_occurrence' AND lift >= 2 THEN 'HIGH_LIFT' END,
            CASE WHEN margin_signal = 'high' THEN 'HIGH_MARGIN_SIGNAL' END], lambda x: x IS NOT NULL) AS reasons
         FROM {prefix}_judged WHERE reject_code IS NULL)
        """,
        f"{prefix}_judged",
    )
    cte(
        f"{prefix}_top",
        f"""
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY total DESC, reliability DESC,
            compatibility = 'compatible' DESC,
            CASE stock_status WHEN 'in_stock' THEN 3 WHEN 'low_stock' THEN 2 WHEN 'unknown' THEN 1 ELSE 0 END DESC,
            z_conf DESC, z_lift DESC, z_sup DESC, z_joint DESC, tgt) AS rank FROM {prefix}_scored)
        WHERE rank <= {pool}
        """,
        f"{prefix}_scored",
    )


cte(
    "behaviour",
    """
    SELECT CAST(user_id AS VARCHAR) AS customer_id, json_extract_string(props, '$.k') AS product_id,
      CASE event_type WHEN 'purchase' THEN 'purchase' WHEN 'error' THEN 'rejection' ELSE 'interest' END AS action,
      CASE event_id % 4 WHEN 0 THEN 2 ELSE 1 END AS cnt, ts AS occurred_at
    FROM events WHERE event_type <> 'signup'
    UNION ALL SELECT CAST(o_custkey AS VARCHAR), CAST(l_partkey AS VARCHAR), 'purchase', 1, o_orderdate
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey
    """,
)
cte(
    "facts",
    """
    SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_type || '-' || p_size AS category,
      p_brand || '-' || (p_size % 10) AS brand,
      CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice * (p_partkey % 500) END AS price,
      CASE WHEN p_partkey % 9 = 0 THEN 'EUR' ELSE 'CLP' END AS currency FROM part
    """,
)
cte(
    "profile",
    """
    SELECT CAST(o_custkey AS VARCHAR) AS customer_id, CASE WHEN o_custkey % 8 = 0 THEN 'USD' ELSE 'CLP' END AS currency,
      min(o_totalprice) AS min_spend, max(o_totalprice) AS max_spend, avg(o_totalprice) AS avg_spend, count(*) AS order_count
    FROM orders GROUP BY ALL
    """,
)
cte(
    "affinity_requests",
    """
    SELECT user_id AS batch_id, event_id AS seq, CASE WHEN user_id % 10 = 0 THEN NULL
      WHEN user_id % 7 = 3 THEN 'new-' || user_id ELSE CAST(user_id AS VARCHAR) END AS customer_id,
      json_extract_string(props, '$.k') AS product_id FROM events
    """,
)
POSITIVE_SIGNALS = {
    "DIRECT_PRODUCT_PURCHASE": ("direct", 3, 0.2),
    "CATEGORY_PURCHASE": ("category", 5, 0.1),
    "BRAND_PURCHASE": ("brand", 5, 0.05),
    "RECENT_PRODUCT_INTEREST": ("product_interest", 3, 0.25),
    "RECENT_CATEGORY_INTEREST": ("category_interest", 3, 0.1),
    "OWNED_COMPATIBLE_PRODUCT": ("owned", 2, 0.15),
    "REPEAT_PURCHASE_PATTERN": ("repeat", 5, 0.1),
    "OBSERVED_SPEND_FIT": ("fit", 1, 0.05),
}
NEGATIVE_SIGNALS = {"PRODUCT_REJECTION": ("product_rejection", 1, 0.5), "CATEGORY_REJECTION": ("category_rejection", 1, 0.25)}
ALL_SIGNALS = POSITIVE_SIGNALS | NEGATIVE_SIGNALS


def affinity_ctes(prefix: str, requests: str, edges: str, ref_time: str | None) -> None:
    """Evidence, signals and the affinity table for (batch_id, seq, customer_id, product_id) requests."""
    ref = f"TIMESTAMP '{ref_time}'" if ref_time else None
    interest = f"occurred_at BETWEEN {ref} - INTERVAL 30 DAY AND {ref}" if ref else "false"
    rejection = f"occurred_at BETWEEN {ref} - INTERVAL 180 DAY AND {ref}" if ref else "true"

    def sums(names: dict[str, str]) -> str:
        return ", ".join(
            f"sum(cnt) FILTER ({cond}) AS {n}_n, max(occurred_at) FILTER ({cond}) AS {n}_t" for n, cond in names.items()
        ) + ", bool_or(action = 'interest') AS saw_interest"

    buy = "action = 'purchase'"
    see, hate = f"action = 'interest' AND {interest}", f"action = 'rejection' AND {rejection}"
    product = sums({"direct": buy, "product_interest": see, "product_rejection": hate})
    category = sums({"category": buy, "category_interest": see, "category_rejection": hate})
    cte(
        f"{prefix}_wide",
        f"""
        SELECT a.*, p.* EXCLUDE (customer_id, product_id, saw_interest), c.* EXCLUDE (customer_id, category, saw_interest),
          b.brand_n, b.brand_t, o.owned_n, o.owned_t, r.repeat_n AS repeat_days, r.repeat_t AS repeat_last, f.price, f.currency,
          p.saw_interest AS saw_product, c.saw_interest AS saw_category, s.currency AS spend_currency,
          CASE WHEN f.price IS NOT NULL AND f.currency = s.currency THEN
            CASE WHEN f.price <= s.max_spend THEN 1.0::DOUBLE WHEN f.price <= s.avg_spend THEN 0.8::DOUBLE END END AS s_fit,
          p.customer_id IS NOT NULL OR c.customer_id IS NOT NULL OR b.customer_id IS NOT NULL OR o.customer_id IS NOT NULL
            AS has_rows
        FROM (SELECT DISTINCT customer_id, product_id FROM {requests} WHERE customer_id IS NOT NULL) a
        LEFT JOIN facts f USING (product_id)
        LEFT JOIN (SELECT customer_id, product_id, {product} FROM behaviour GROUP BY 1, 2) p
          ON p.customer_id = a.customer_id AND p.product_id = a.product_id
        LEFT JOIN (SELECT customer_id, category, {category} FROM behaviour JOIN facts USING (product_id) GROUP BY 1, 2) c
          ON c.customer_id = a.customer_id AND c.category = f.category
        LEFT JOIN (SELECT customer_id, brand, sum(cnt) AS brand_n, max(occurred_at) AS brand_t
            FROM behaviour JOIN facts USING (product_id) WHERE {buy} GROUP BY 1, 2) b
          ON b.customer_id = a.customer_id AND b.brand = f.brand
        LEFT JOIN (SELECT customer_id, source_product_id AS product_id, count(*) AS owned_n, max(t) AS owned_t
            FROM (SELECT customer_id, product_id AS own, max(occurred_at) AS t FROM behaviour WHERE {buy} GROUP BY 1, 2)
            JOIN (SELECT DISTINCT source_product_id, target_product_id FROM {edges}) ON target_product_id = own GROUP BY 1, 2) o
          ON o.customer_id = a.customer_id AND o.product_id = a.product_id
        LEFT JOIN (SELECT customer_id, product_id, count(DISTINCT CAST(occurred_at AS DATE)) AS repeat_n,
            max(occurred_at) AS repeat_t FROM behaviour WHERE {buy} GROUP BY 1, 2) r
          ON r.customer_id = a.customer_id AND r.product_id = a.product_id
        LEFT JOIN profile s ON s.customer_id = a.customer_id
        """,
        requests,
        edges,
        "behaviour",
        "facts",
        "profile",
    )
    strengths = ", ".join(
        f"CASE WHEN {n}_n > 0 THEN least(1.0::DOUBLE, {n}_n / {d}.0::DOUBLE) END AS s_{n}"
        for n, d, _ in ALL_SIGNALS.values()
        if n not in ("fit", "repeat")
    )
    cte(
        f"{prefix}_signals",
        f"""
        SELECT *, {strengths}, CASE WHEN repeat_days >= 2 THEN least(1.0::DOUBLE, repeat_days / 5.0::DOUBLE) END AS s_repeat,
          CASE WHEN repeat_days >= 2 THEN repeat_days END AS repeat_n, CASE WHEN repeat_days >= 2 THEN repeat_last END AS repeat_t,
          CASE WHEN s_fit IS NOT NULL THEN 1 END AS fit_n, CAST(NULL AS TIMESTAMP) AS fit_t,
          list_filter([{"NULL" if ref else "CASE WHEN saw_product THEN 'REFERENCE_TIME_UNAVAILABLE' END"},
            {"NULL" if ref else "CASE WHEN saw_category THEN 'REFERENCE_TIME_UNAVAILABLE' END"},
            CASE WHEN price IS NOT NULL AND spend_currency IS NULL THEN 'SPEND_PROFILE_UNAVAILABLE' END,
            CASE WHEN price IS NOT NULL AND spend_currency <> currency THEN 'CURRENCY_MISMATCH' END],
            lambda x: x IS NOT NULL) AS own_warnings
        FROM {prefix}_wide WHERE has_rows
        """,
        f"{prefix}_wide",
    )
    z = lambda n: f"coalesce(s_{n}, 0.0::DOUBLE)"
    plus = " + ".join(f"{z(n)} * {w}::DOUBLE" for n, _, w in POSITIVE_SIGNALS.values())
    minus = " + ".join(f"{z(n)} * {w}::DOUBLE" for n, _, w in NEGATIVE_SIGNALS.values())
    total = sum(w for _, _, w in POSITIVE_SIGNALS.values())
    types = " + ".join(f"CAST(s_{n} IS NOT NULL AS INTEGER)" for n, _, _ in ALL_SIGNALS.values())
    bad = " + ".join(f"CAST(s_{n} IS NOT NULL AS INTEGER)" for n, _, _ in NEGATIVE_SIGNALS.values())
    count = " + ".join(f"CASE WHEN s_{n} IS NOT NULL THEN {n}_n ELSE 0 END" for n, _, _ in ALL_SIGNALS.values())
    cte(
        f"{prefix}_scores",
        f"""
        SELECT *, CASE WHEN signal_types = 0 OR pieces = 0 THEN 'none' WHEN signal_types >= 3 AND pieces >= 3 THEN 'high'
            WHEN signal_types >= 2 AND pieces >= 2 THEN 'medium' ELSE 'low' END AS conf
        FROM (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (({plus}) - ({minus})) / {total!r}::DOUBLE)) AS score,
          {types} AS signal_types, {bad} AS negatives, {count} AS pieces FROM {prefix}_signals)
        """,
        f"{prefix}_signals",
    )
    kept = ", ".join(f"CASE WHEN has THEN s_{n} END AS s_{n}" for n, _, _ in ALL_SIGNALS.values())
    cte(
        f"{prefix}_table",
        f"""
        SELECT batch_id, seq, customer_id, product_id, known, has, coalesce(score, 0.0::DOUBLE) AS affinity_score,
          coalesce(conf, 'none') AS confidence, coalesce(signal_types, 0) AS signal_types, coalesce(negatives, 0) AS negatives,
          coalesce(pieces, 0) AS pieces, {kept},
          CASE WHEN has THEN own_warnings WHEN known AND with_evidence > 0 THEN ['PARTIAL_CUSTOMER_HISTORY']
            WHEN known THEN ['NO_CUSTOMER_HISTORY'] ELSE [] END AS affinity_warnings,
          CASE WHEN NOT known THEN 'CUSTOMER_NOT_IDENTIFIED' WHEN with_evidence = 0 THEN 'NO_CUSTOMER_HISTORY'
            WHEN with_evidence < products THEN 'PARTIAL_CUSTOMER_HISTORY' END AS batch_warning
        FROM (SELECT r.*, r.customer_id IS NOT NULL AS known, s.product_id IS NOT NULL AS has,
            s.* EXCLUDE (customer_id, product_id), count(*) OVER (PARTITION BY batch_id) AS products,
            count(s.product_id) OVER (PARTITION BY batch_id) AS with_evidence
          FROM (SELECT batch_id, customer_id, product_id, min(seq) AS seq FROM {requests} GROUP BY ALL) r
          LEFT JOIN {prefix}_scores s ON s.customer_id = r.customer_id AND s.product_id = r.product_id)
        """,
        f"{prefix}_scores",
    )
