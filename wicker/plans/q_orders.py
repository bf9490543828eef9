"""Queries over the order source and the normaliser."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from wicker.operators import normalise as N
from wicker.params import NormaliseParams
from wicker.plans import views as V
from wicker.plans.registry import cte, query
from wicker.sources import orders as O

STATES = ("O", "F")
EXCLUDED = tuple(str(n) for n in range(1, 41))
TIES = ("l_partkey", "l_suppkey", "l_quantity", "l_shipdate")


@query(
    "order_line_scan",
    f"""SELECT order_id, strftime(occurred_at, '%Y-%m-%d %H:%M:%S') AS occurred_at, order_state, line_id,
        product_id, quantity FROM order_view
        WHERE occurred_at BETWEEN TIMESTAMP '{V.NARROW[0]}' AND TIMESTAMP '{V.NARROW[1]}'""",
    "order_view",
)
def _(spark, sf):
    found = O.order_lines(*V.order_view(spark, sf), *V.NARROW)
    return found.select(
        "order_id", V.stamp("occurred_at").alias("occurred_at"), "order_state", "line_id", "product_id", "quantity"
    )


cte(
    "tagged_lines",
    f"""
    SELECT *, CASE WHEN line_id IS NULL THEN 'INCOMPLETE' WHEN NOT order_accepted THEN 'ORDER_EXCLUDED'
        WHEN n > 1 THEN 'DUPLICATE_LINE'
        WHEN trim(product_id) = '' OR quantity <= 0 OR quantity <> floor(quantity) THEN 'INVALID_LINE'
        WHEN CAST(product_id AS BIGINT) BETWEEN 1 AND 40 THEN 'PRODUCT_EXCLUDED' END AS drop_reason
    FROM (SELECT *, order_state IN ('O', 'F') AS order_accepted,
            row_number() OVER (PARTITION BY order_id, line_id ORDER BY occurred_at, {", ".join(TIES)}) AS n
          FROM order_view)
    """,
    "order_view",
)


def tagged(spark, sf):
    orders, lines = V.order_view(spark, sf)
    return O.tag_lines(O.order_lines(orders, lines, V.WINDOW[0]), STATES, EXCLUDED, TIES)


@query(
    "order_cleanse",
    "SELECT order_id, line_id, product_id, quantity, l_suppkey FROM tagged_lines WHERE drop_reason IS NULL",
    "tagged_lines",
)
def _(spark, sf):
    return O.clean_lines(tagged(spark, sf)).select("order_id", "line_id", "product_id", "quantity", "l_suppkey")


@query(
    "order_cleanse_stats",
    """SELECT count(DISTINCT order_id) FILTER (line_id IS NOT NULL) AS source_orders_read,
       count(*) AS source_lines_read,
       count(DISTINCT order_id) FILTER (line_id IS NOT NULL AND NOT order_accepted) AS source_orders_excluded,
       count(*) FILTER (drop_reason IS NOT NULL) AS source_lines_excluded,
       count(*) FILTER (drop_reason = 'DUPLICATE_LINE') AS source_duplicate_lines_excluded,
       count(*) FILTER (drop_reason = 'PRODUCT_EXCLUDED') AS source_products_excluded FROM tagged_lines""",
    "tagged_lines",
)
def _(spark, sf):
    return O.read_stats(tagged(spark, sf))


@query(
    "order_regroup",
    """SELECT order_id AS transaction_id, 'order' AS transaction_type,
       strftime(min(occurred_at), '%Y-%m-%d %H:%M:%S') AS occurred_at, min(order_state) AS status,
       count(*) FILTER (drop_reason IS NULL) AS line_count,
       coalesce(sum(quantity) FILTER (drop_reason IS NULL), 0.0) AS total_quantity,
       'shop' AS source_system, 'order:' || order_id AS source_reference
       FROM tagged_lines WHERE line_id IS NOT NULL AND order_accepted GROUP BY order_id""",
    "tagged_lines",
)
def _(spark, sf):
    return O.transaction_headers(tagged(spark, sf)).withColumn("occurred_at", V.stamp("occurred_at"))


FROM, TO = "1995-01-01 00:00:00", "2001-12-31 00:00:00"
LATER = "1995-03-01 00:00:00"  # only where records outside the window are what is shown
OPEN = NormaliseParams(STATES, ("O", "P"), ("R",), window_from=FROM, window_to=TO)
CAPPED = replace(OPEN, max_products=5)
STRICT = replace(OPEN, allow_anonymous=False, window_from=LATER)


def normalise_ctes(prefix: str, customer_rule: str, start: str) -> None:
    cte(
        f"{prefix}_checked",
        f"""
        SELECT *, CASE WHEN trim(transaction_id) = '' THEN 'INVALID_TRANSACTION_ID'
          WHEN transaction_type NOT IN ('order', 'cart') THEN 'INVALID_TRANSACTION_TYPE'
          WHEN instant IS NULL THEN 'INVALID_OCCURRED_AT'
          WHEN instant NOT BETWEEN TIMESTAMP '{start}' AND TIMESTAMP '{TO}' THEN 'OUTSIDE_DATA_WINDOW'
          WHEN transaction_type = 'order' AND status NOT IN ('O', 'F') THEN 'STATUS_NOT_ACCEPTED'
          WHEN transaction_type = 'cart' AND status NOT IN ('O', 'P') THEN 'STATUS_NOT_ACCEPTED'
          {customer_rule} END AS own_code
        FROM raw_headers
        """,
        "raw_headers",
    )
    cte(
        f"{prefix}_headers",
        f"""
        SELECT c.*, CASE WHEN own_code IS NOT NULL THEN own_code
          WHEN EXISTS (SELECT 1 FROM {prefix}_checked e WHERE e.own_code IS NULL AND e.has_lines
             AND e.transaction_id = c.transaction_id AND e.transaction_type = c.transaction_type
             AND e.seq < c.seq) THEN 'DUPLICATE_TRANSACTION'
          WHEN NOT has_lines THEN 'INVALID_TRANSACTION' END AS head_code
        FROM {prefix}_checked c
        """,
        f"{prefix}_checked",
    )


normalise_ctes("strict", "WHEN customer_key IS NULL THEN 'MISSING_CUSTOMER_KEY'", LATER)
normalise_ctes("open", "", FROM)
cte(
    "n_lines",
    """
    SELECT l.*, transaction_id, CASE WHEN trim(product_id) = '' THEN 'INVALID_PRODUCT_ID'
      WHEN combination_id IS NOT NULL AND trim(combination_id) = '' THEN 'INVALID_COMBINATION_ID'
      WHEN quantity <= 0 OR quantity <> floor(quantity) THEN 'INVALID_QUANTITY'
      WHEN line_status = 'R' THEN 'LINE_STATUS_REJECTED' END AS line_code
    FROM raw_lines l JOIN open_headers h USING (seq) WHERE head_code IS NULL
    """,
    "raw_lines",
    "open_headers",
)
cte(
    "n_products",
    """SELECT seq, product_id, combination_id, CAST(sum(quantity) AS BIGINT) AS quantity, count(*) AS lines
       FROM n_lines WHERE line_code IS NULL GROUP BY ALL""",
    "n_lines",
)
cte(
    "n_final",
    """
    SELECT h.*, coalesce(head_code, CASE WHEN products IS NULL THEN 'NO_VALID_LINES'
        WHEN products > 50 THEN 'TOO_MANY_DISTINCT_PRODUCTS' END) AS reject_code,
      coalesce(products, 0) AS products, coalesce(ok_lines, 0) AS ok_lines, coalesce(bad_lines, 0) AS bad_lines
    FROM open_headers h
    LEFT JOIN (SELECT seq, count(*) AS products, sum(lines) AS ok_lines FROM n_products GROUP BY seq) USING (seq)
    LEFT JOIN (SELECT seq, count(*) AS bad_lines FROM n_lines WHERE line_code IS NOT NULL GROUP BY seq) USING (seq)
    """,
    "open_headers",
    "n_products",
)
cte("n_ok", "SELECT * FROM n_final WHERE reject_code IS NULL", "n_final")
cte(
    "n_items",
    """SELECT transaction_id, transaction_type, instant AS occurred_at, customer_key, product_id, combination_id,
       quantity, seq FROM n_products JOIN n_final USING (seq) WHERE reject_code IS NULL""",
    "n_final",
)


def run(spark, sf, p=OPEN):
    return N.normalise(V.raw_headers(spark, sf), V.raw_lines(spark, sf), p)


@query("txn_classify", "SELECT seq, transaction_id, head_code AS reject_code FROM strict_headers", "strict_headers")
def _(spark, sf):
    found = N.classify_transactions(V.raw_headers(spark, sf), STRICT)
    return found.select("seq", "transaction_id", "reject_code")


@query("line_classify", "SELECT seq, line_seq, line_code FROM n_lines", "n_lines")
def _(spark, sf):
    return run(spark, sf).lines.select("seq", "line_seq", "line_code")


@query(
    "line_reject",
    """SELECT transaction_id, line_id, product_id, combination_id, line_code
       FROM n_lines WHERE line_code IS NOT NULL""",
    "n_lines",
)
def _(spark, sf):
    return N.rejected_lines(run(spark, sf)).select(
        "transaction_id", "line_id", "product_id", "combination_id", "line_code"
    )


@query(
    "txn_dedup",
    """SELECT seq, transaction_type, transaction_id FROM open_headers WHERE head_code = 'DUPLICATE_TRANSACTION'""",
    "open_headers",
)
def _(spark, sf):
    found = N.classify_transactions(V.raw_headers(spark, sf), OPEN)
    return found.filter(F.col("reject_code") == "DUPLICATE_TRANSACTION").select(
        "seq", "transaction_type", "transaction_id"
    )


@query(
    "basket_items",
    """SELECT transaction_id, transaction_type, strftime(occurred_at, '%Y-%m-%d %H:%M:%S') AS occurred_at,
       customer_key, product_id, combination_id, quantity FROM n_items""",
    "n_items",
)
def _(spark, sf):
    return run(spark, sf).items.select(
        "transaction_id",
        "transaction_type",
        V.stamp("occurred_at").alias("occurred_at"),
        "customer_key",
        *N.ITEM,
        "quantity",
    )


@query("txn_no_lines", "SELECT seq, transaction_id FROM n_final WHERE reject_code = 'NO_VALID_LINES'", "n_final")
def _(spark, sf):
    found = run(spark, sf).headers
    return found.filter(F.col("reject_code") == "NO_VALID_LINES").select("seq", "transaction_id")


@query(
    "basket_size_cap",
    """SELECT seq, transaction_id, products AS product_count FROM n_final
       WHERE reject_code IS NULL AND products > 5 OR reject_code = 'TOO_MANY_DISTINCT_PRODUCTS'""",
    "n_final",
)
def _(spark, sf):
    found = run(spark, sf, CAPPED).headers.filter(F.col("reject_code") == "TOO_MANY_DISTINCT_PRODUCTS")
    return found.select("seq", "transaction_id", "product_count")


@query(
    "normalise_warnings",
    """
    SELECT 'PARTIAL_TRANSACTION' AS code, seq, transaction_id, NULL AS product_id, NULL AS combination_id,
           NULL AS line_id, CAST(NULL AS BIGINT) AS aggregated_quantity, NULL AS source_system
      FROM n_ok WHERE bad_lines > 0
    UNION ALL SELECT 'ANONYMOUS_TRANSACTION', seq, transaction_id, NULL, NULL, NULL, NULL, NULL
      FROM n_ok WHERE customer_key IS NULL
    UNION ALL SELECT 'SOURCE_REFERENCE_MISSING', seq, transaction_id, NULL, NULL, NULL, NULL, 'shop'
      FROM n_ok WHERE source_reference IS NULL
    UNION ALL SELECT 'PRODUCT_LINES_AGGREGATED', seq, transaction_id, product_id, combination_id, line_id,
        CAST(running AS BIGINT), NULL
      FROM (SELECT *, row_number() OVER w AS n, sum(quantity) OVER w AS running FROM n_lines
            WHERE line_code IS NULL WINDOW w AS (PARTITION BY seq, product_id, combination_id ORDER BY line_seq
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE n > 1
    UNION ALL SELECT 'EMPTY_INPUT', NULL, NULL, NULL, NULL, NULL, NULL, NULL
      FROM (SELECT count(*) AS c FROM n_final) WHERE c = 0
    """,
    "n_ok",
)
def _(spark, sf):
    return N.warnings(run(spark, sf))


@query(
    "normalise_stats",
    """SELECT count(*) AS transactions_read, count(*) FILTER (reject_code IS NULL) AS transactions_accepted,
       count(*) FILTER (reject_code IS NOT NULL) AS transactions_rejected,
       (SELECT count(*) FROM raw_lines JOIN raw_headers USING (seq) WHERE has_lines) AS lines_read,
       CAST(sum(ok_lines) AS BIGINT) AS lines_accepted, CAST(sum(bad_lines) AS BIGINT) AS lines_rejected,
       CAST(sum(ok_lines - products) AS BIGINT) AS duplicate_product_lines_aggregated,
       count(*) FILTER (reject_code IS NULL AND customer_key IS NULL) AS anonymous_transactions_accepted,
       (SELECT count(*) FROM (SELECT DISTINCT product_id, combination_id FROM n_items)) AS distinct_products_observed
       FROM n_final""",
    "n_items",
)
def _(spark, sf):
    return N.stats(run(spark, sf), V.raw_lines(spark, sf))


@query(
    "txn_sorted",
    """SELECT transaction_id, strftime(occurred_at, '%Y-%m-%d %H:%M:%S') AS occurred_at, product_id, combination_id,
       quantity FROM n_items""",
    "n_items",
)
def _(spark, sf):
    items = N.in_output_order(run(spark, sf).items)
    return items.select("transaction_id", V.stamp("occurred_at").alias("occurred_at"), *N.ITEM, "quantity")


cte(
    "contract",
    """
    SELECT 'TRANSACTION_ID' AS "check", transaction_id AS key, count(DISTINCT seq) AS occurrences
      FROM n_items GROUP BY transaction_id HAVING count(DISTINCT seq) > 1
    UNION ALL SELECT 'TRANSACTION_PRODUCT', seq || '|' || transaction_id || '|' || product_id || '|'
        || coalesce(combination_id, ''), count(*) FROM n_items GROUP BY ALL HAVING count(*) > 1
    UNION ALL SELECT 'RULE', product_id || '|' || combination_id || '|' || kind, count(*)
      FROM dataset_rules GROUP BY ALL HAVING count(*) > 1
    """,
    "n_items",
    "dataset_rules",
)
cte(
    "dataset_rules",
    """SELECT CAST(p_partkey // 2 AS VARCHAR) AS product_id, CAST(p_size AS VARCHAR) AS combination_id,
       CASE WHEN p_partkey % 2 = 0 THEN 'manual' ELSE p_brand END AS kind FROM part
       UNION ALL SELECT CAST(p_partkey AS VARCHAR), '1', 'manual' FROM part
       UNION ALL SELECT CAST(p_partkey AS VARCHAR), CAST(p_size AS VARCHAR), 'manual' FROM part""",
)


def dataset_rules(spark, sf):
    part = V.table(spark, sf, "part")
    kind = F.when(F.col("p_partkey") % 2 == 0, F.lit("manual")).otherwise(F.col("p_brand"))
    half = part.select(
        V.text(F.floor(F.col("p_partkey") / 2).cast("bigint")).alias("product_id"),
        V.text("p_size").alias("combination_id"),
        kind.alias("kind"),
    )
    one = part.select(V.text("p_partkey").alias("product_id"), F.lit("1").alias("combination_id"), F.lit("manual").alias("kind"))
    sized = part.select(
        V.text("p_partkey").alias("product_id"), V.text("p_size").alias("combination_id"), F.lit("manual").alias("kind")
    )
    return half.unionByName(one).unionByName(sized)


@query("dataset_contract", "SELECT * FROM contract", "contract")
def _(spark, sf):
    return N.contract_violations(run(spark, sf).items, dataset_rules(spark, sf))
