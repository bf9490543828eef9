"""Queries over the catalogue reads, prices and commercial truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from wicker.operators import pricing as P
from wicker.plans import views as V
from wicker.plans.oracle_views import PRICE_SQL, STATUS_SQL, rule_ctes
from wicker.plans.registry import cte, query
from wicker.sources import catalog as Cat

AS_OF = V.AS_OF
rule_ctes("req", "cat_requests", AS_OF)
rule_ctes("truth", "truth_references", AS_OF)


def both(spark, sf):
    return V.catalog(spark, sf), V.catalog_requests(spark, sf)


def real(*names: str):
    return [F.col(n).cast("double").alias(n) for n in names]


@query(
    "catalog_products",
    """SELECT product_id, name, reference AS product_reference, '<p>' || replace(short_description, '&', '&amp;') || '</p>'
         AS description, coalesce(category, '  ') AS category, active,
         coalesce(shop_orderable, available_for_order) AS available_for_order,
         CAST(coalesce(shop_price, price) AS DOUBLE) AS base_price_net FROM cat_product""",
    "cat_product",
)
def _(spark, sf):
    return Cat.catalog_products(V.catalog(spark, sf)).withColumn(
        "base_price_net", F.col("base_price_net").cast("double")
    )


@query(
    "catalog_combinations",
    """SELECT product_id, combination_id, reference AS combination_reference, CAST(impact_net AS DOUBLE) AS impact_net,
       default_on FROM cat_variant""",
    "cat_variant",
)
def _(spark, sf):
    return Cat.catalog_combinations(V.catalog(spark, sf)).withColumn("impact_net", F.col("impact_net").cast("double"))


@query(
    "stock_scan",
    """SELECT product_id, combination_id, physical_quantity FROM cat_stock s WHERE EXISTS
       (SELECT 1 FROM cat_requests q WHERE q.product_id = s.product_id AND q.combination_id = s.combination_id)""",
    "cat_stock",
    "cat_requests",
)
def _(spark, sf):
    return Cat.stock_scan(*both(spark, sf))


@query("price_rule_scope", "SELECT request_id, rule_id FROM req_scoped", "req_scoped")
def _(spark, sf):
    return Cat.price_rules_scoped(V.catalog_requests(spark, sf), V.price_rules(spark, sf)).select("request_id", "rule_id")


@query("price_rules_valid", "SELECT request_id, rule_id FROM req_scoped WHERE valid", "req_scoped")
def _(spark, sf):
    found = Cat.price_rules_valid(V.catalog_requests(spark, sf), V.price_rules(spark, sf), AS_OF)
    return found.select("request_id", "rule_id")


@query(
    "catalog_assemble",
    """SELECT request_id, product_id, combination_id, name, product_reference, combination_reference, description,
       category, active, available_for_order, CAST(base_price_net AS DOUBLE) AS base_price_net,
       CAST(impact_net AS DOUBLE) AS impact_net, stock_quantity FROM assembled""",
    "assembled",
)
def _(spark, sf):
    drop = ["quantity", "shop_id", "currency_id", "country_id", "group_id", "customer_id"]
    found = Cat.assemble_catalog(*both(spark, sf)).drop(*drop)
    return found.withColumns({c: F.col(c).cast("double") for c in ("base_price_net", "impact_net")})


@query(
    "product_core",
    """SELECT product_id, name, reference AS sku, short_description, long_description FROM cat_product WHERE active""",
    "cat_product",
)
def _(spark, sf):
    return Cat.product_core(*both(spark, sf))


cte(
    "variant_rows",
    """
    SELECT v.product_id, v.combination_id, v.reference AS sku, l.label, CAST(v.impact_net AS DOUBLE) AS impact_net,
      s.physical_quantity, s.physical_quantity > 0 AS available, coalesce(v.default_on, 0) = 1 AS is_default
    FROM cat_variant v JOIN cat_product p ON p.product_id = v.product_id AND p.active
    JOIN cat_stock s ON s.product_id = v.product_id AND s.combination_id = v.combination_id
    LEFT JOIN cat_labels l ON l.combination_id = v.combination_id
    """,
    "cat_product",
    "cat_stock",
    "cat_labels",
)


@query("variant_listing", "SELECT * FROM variant_rows", "variant_rows")
def _(spark, sf):
    found = Cat.variants(*both(spark, sf))
    return found.withColumn("impact_net", F.col("impact_net").cast("double"))


@query(
    "variant_attributes",
    """SELECT v.product_id, combination_id, string_agg("group" || '=' || value, ';' ORDER BY "group", value) AS attributes
       FROM cat_variant v JOIN cat_attributes USING (combination_id) JOIN cat_product p ON p.product_id = v.product_id
       GROUP BY ALL""",
    "cat_product",
    "cat_attributes",
)
def _(spark, sf):
    found = Cat.variant_attributes(*both(spark, sf))
    joined = F.transform("attributes", lambda a: F.concat_ws("=", a["group"], a["value"]))
    return found.withColumn("attributes", F.array_join(joined, ";"))


@query(
    "base_prices",
    """SELECT request_id, CAST(CASE WHEN p.active THEN coalesce(p.shop_price, p.price, 0) ELSE 0 END AS DOUBLE) AS product_price,
       CAST(CASE WHEN p.active THEN coalesce(v.impact_net, 0) ELSE 0 END AS DOUBLE) AS combination_impact
       FROM cat_requests q JOIN cat_product p USING (product_id)
       LEFT JOIN cat_variant v ON v.product_id = q.product_id AND v.combination_id = q.combination_id""",
    "cat_requests",
    "cat_product",
    "cat_variant",
)
def _(spark, sf):
    return Cat.base_prices(*both(spark, sf)).select("request_id", *real("product_price", "combination_impact"))


@query(
    "stock_by_variant",
    """SELECT request_id, CASE WHEN s.product_id IS NOT NULL THEN coalesce(physical_quantity, 0) END AS physical_quantity,
       coalesce(physical_quantity > 0, false) AS available
       FROM cat_requests q LEFT JOIN cat_stock s ON s.product_id = q.product_id AND s.combination_id = q.combination_id""",
    "cat_requests",
    "cat_stock",
)
def _(spark, sf):
    return Cat.stock_by_variant(*both(spark, sf)).select("request_id", "physical_quantity", "available")


@query(
    "stock_by_product",
    """SELECT product_id, combination_id, coalesce(physical_quantity, 0) AS physical_quantity,
       coalesce(physical_quantity, 0) > 0 AS available FROM cat_stock WHERE product_id >= 0""",
    "cat_stock",
)
def _(spark, sf):
    return Cat.stock_by_product(*both(spark, sf))


@query(
    "default_variant",
    """SELECT product_id, min(combination_id) AS combination_id FROM cat_variant JOIN cat_product USING (product_id)
       WHERE active AND default_on = 1 GROUP BY product_id""",
    "cat_variant",
    "cat_product",
)
def _(spark, sf):
    return Cat.default_variant(*both(spark, sf))


cte(
    "assembled_status",
    f"SELECT *, {STATUS_SQL} AS status FROM assembled",
    "assembled",
)


@query(
    "availability",
    """SELECT request_id, status, status = 'available' AS purchasable, stock_quantity IS NOT NULL AS stock_known,
       CAST(trunc(stock_quantity) AS BIGINT) AS stock_quantity FROM assembled_status""",
    "assembled_status",
)
def _(spark, sf):
    found = P.availability(Cat.assemble_catalog(*both(spark, sf)))
    return found.select("request_id", "status", "purchasable", "stock_known", "stock_quantity")


cte(
    "selection",
    """
    SELECT q.request_id, b.rule_id, CASE WHEN b.tied THEN b.next_id END AS ambiguous_with,
      coalesce(i.n, 0) AS invalid_dates
    FROM cat_requests q LEFT JOIN req_best b USING (request_id)
    LEFT JOIN (SELECT request_id, count(*) AS n FROM req_scoped WHERE unreadable GROUP BY 1) i USING (request_id)
    """,
    "req_best",
    "cat_requests",
)


@query("price_rule_select", "SELECT request_id, rule_id, invalid_dates FROM selection", "selection")
def _(spark, sf):
    found = P.select_price_rule(V.catalog_requests(spark, sf), V.price_rules(spark, sf), AS_OF)
    return found.select("request_id", "rule_id", "invalid_dates")


@query(
    "price_rule_ambiguous",
    "SELECT request_id, rule_id, ambiguous_with FROM selection WHERE ambiguous_with IS NOT NULL",
    "selection",
)
def _(spark, sf):
    found = P.select_price_rule(V.catalog_requests(spark, sf), V.price_rules(spark, sf), AS_OF)
    return found.filter(F.col("ambiguous_with").isNotNull()).select("request_id", "rule_id", "ambiguous_with")


cte(
    "ruled",
    """SELECT a.*, b.rule_id, b.rule_price, b.reduction, b.reduction_type FROM assembled a LEFT JOIN req_best b
       USING (request_id)""",
    "assembled",
    "req_best",
)
cte("priced", PRICE_SQL.format(source="ruled"), "ruled")


@query(
    "commercial_price",
    """SELECT request_id, base_gross, final_gross, discount_type, discount_value, specific_price_id,
       array_to_string(price_warnings, ',') AS price_warnings FROM priced""",
    "priced",
)
def _(spark, sf):
    cat, requests = both(spark, sf)
    selected = P.select_price_rule(Cat.assemble_catalog(cat, requests), V.price_rules(spark, sf), AS_OF)
    return P.commercial_price(selected).select(
        "request_id",
        "base_gross",
        "final_gross",
        "discount_type",
        "discount_value",
        "specific_price_id",
        F.array_join("price_warnings", ",").alias("price_warnings"),
    )


cte(
    "truth_ruled",
    f"""SELECT a.*, b.rule_id, b.rule_price, b.reduction, b.reduction_type, b.tied, {STATUS_SQL} AS status,
       coalesce(i.n, 0) AS invalid_dates FROM truth_assembled a LEFT JOIN truth_best b USING (request_id)
       LEFT JOIN (SELECT request_id, count(*) AS n FROM truth_scoped WHERE unreadable GROUP BY 1) i USING (request_id)""",
    "truth_assembled",
    "truth_best",
)
cte("truth_priced", PRICE_SQL.format(source="truth_ruled"), "truth_ruled")
cte(
    "truth",
    """
    SELECT ref_product AS product_id, ref_combination AS combination_id, name,
      coalesce(combination_reference, product_reference) AS reference, description, category,
      coalesce(active, false) AS active, coalesce(available_for_order, false) AS available_for_order, status,
      status = 'available' AS purchasable, stock_quantity IS NOT NULL AS stock_known,
      CAST(trunc(stock_quantity) AS BIGINT) AS stock_quantity, base_gross, final_gross,
      CASE WHEN priced THEN 'CLP' END AS currency, final_gross < base_gross AS discount_applied, discount_type,
      discount_value, specific_price_id,
      list_concat(list_concat(CASE WHEN invalid_dates > 0 THEN list_transform(range(invalid_dates), lambda x: 'SPECIFIC_PRICE_INVALID_DATE') ELSE [] END,
        list_filter([CASE WHEN tied THEN 'SPECIFIC_PRICE_SELECTION_AMBIGUOUS' END,
          CASE WHEN status = 'unknown' THEN 'CATALOG_COMMERCIAL_STATUS_UNKNOWN' END], lambda x: x IS NOT NULL)), price_warnings) AS warnings
    FROM truth_priced
    """,
    "truth_priced",
)


def truth(spark, sf):
    return P.commercial_truth(
        V.truth_requests(spark, sf), V.catalog(spark, sf, stored=True), V.price_rules(spark, sf), V.CONTEXT, AS_OF
    )


@query(
    "commercial_truth",
    "SELECT * EXCLUDE (warnings), array_to_string(warnings, ',') AS warnings FROM truth",
    "truth",
)
def _(spark, sf):
    return truth(spark, sf).withColumn("warnings", F.array_join("warnings", ","))


@query(
    "truth_stats",
    """SELECT (SELECT count(*) FROM truth_references) AS requested, count(*) AS resolved,
       (SELECT count(*) FROM truth_references) - count(*) AS missing,
       count(*) FILTER (status = 'inactive') AS inactive,
       count(*) FILTER (status = 'unavailable_for_order') AS unavailable_for_order,
       count(*) FILTER (status = 'out_of_stock') AS out_of_stock,
       count(*) FILTER (final_gross IS NULL) AS price_unavailable,
       CAST(sum(len(warnings)) AS BIGINT) AS warnings_generated FROM truth""",
    "truth",
)
def _(spark, sf):
    return P.truth_stats(V.truth_requests(spark, sf), truth(spark, sf))


cte(
    "quoted",
    """
    SELECT request_id, product_id, combination_id, quantity, base_unit_price, unit_price, unit_price * quantity AS subtotal,
      unit_price < base_unit_price AS discount_applied,
      CASE WHEN reduction > 0 AND reduction_type IN ('percentage', 'amount') THEN reduction_type END AS discount_type,
      CASE WHEN reduction > 0 AND reduction_type = 'percentage' THEN CAST(round(reduction, 4) AS DOUBLE)
        WHEN reduction > 0 AND reduction_type = 'amount' AND reduction_tax = 1 THEN round(CAST(reduction AS DOUBLE) / 1.19, 0)
        WHEN reduction > 0 AND reduction_type = 'amount' THEN CAST(round(reduction, 0) AS DOUBLE) END AS discount_value,
      rule_id AS specific_price_id
    FROM (SELECT *, CAST(round(catalog_net * 1.19, 0) AS BIGINT) AS base_unit_price,
        CAST(round(greatest(CASE
          WHEN reduction > 0 AND reduction_type = 'percentage' THEN CAST(net * (1 - CAST(reduction AS DECIMAL(12,6))) * 1.19 AS DECIMAL(30,10))
          WHEN reduction > 0 AND reduction_type = 'amount' AND reduction_tax = 1 THEN CAST(net * 1.19 - reduction AS DECIMAL(30,10))
          WHEN reduction > 0 AND reduction_type = 'amount' THEN CAST((net - reduction) * 1.19 AS DECIMAL(30,10))
          ELSE CAST(net * 1.19 AS DECIMAL(30,10)) END, 0), 0) AS BIGINT) AS unit_price
      FROM (SELECT *, CAST(CASE WHEN rule_price >= 0 THEN rule_price + impact ELSE catalog_net END AS DECIMAL(18,6)) AS net
        FROM (SELECT q.*, r.rule_id, r.rule_price, r.reduction, r.reduction_type, r.reduction_tax,
            CASE WHEN p.active THEN coalesce(v.impact_net, 0) ELSE CAST(0 AS DECIMAL(20,6)) END AS impact,
            CAST(greatest(CASE WHEN p.active THEN coalesce(p.shop_price, p.price, 0) + coalesce(v.impact_net, 0) ELSE 0 END, 0)
              AS DECIMAL(18,6)) AS catalog_net
          FROM cat_requests q JOIN cat_product p USING (product_id)
          LEFT JOIN cat_variant v ON v.product_id = q.product_id AND v.combination_id = q.combination_id
          LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY r_combination = combination_id DESC,
              r_shop = shop_id DESC, r_currency = currency_id DESC, r_country = country_id DESC, r_group = group_id DESC,
              r_customer = customer_id DESC, from_quantity DESC, coalesce(priority, 0) DESC, rule_id) AS n
            FROM req_scoped WHERE valid) r ON r.request_id = q.request_id AND r.n = 1)))
    """,
    "cat_requests",
    "cat_product",
    "cat_variant",
    "req_scoped",
)


def quotes(spark, sf):
    cat, requests = both(spark, sf)
    return P.price_quote(requests, cat, V.price_rules(spark, sf), AS_OF)


QUOTE = ["base_unit_price", "unit_price", "subtotal", "discount_applied", "discount_type", "discount_value", "specific_price_id"]


@query("price_quote", f"SELECT request_id, {', '.join(QUOTE)} FROM quoted", "quoted")
def _(spark, sf):
    return quotes(spark, sf).select("request_id", *QUOTE)


@query(
    "price_parity",
    """SELECT product_id, combination_id, quantity, expected_price, unit_price AS actual_price FROM
       (SELECT q.product_id, q.combination_id, q.quantity,
          CAST(floor(p_retailprice * 1.19::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS expected_price, unit_price
        FROM quoted q JOIN part ON p_partkey = q.product_id) WHERE expected_price <> unit_price""",
    "quoted",
)
def _(spark, sf):
    part = V.table(spark, sf, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.floor(F.col("p_retailprice") * 1.19 + 0.5).cast("bigint").alias("expected_price"),
    )
    expected = V.catalog_requests(spark, sf).select("product_id", "combination_id", "quantity").join(part, "product_id")
    return P.price_parity(expected, quotes(spark, sf))
