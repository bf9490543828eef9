"""Catalogue reads over shop tables, each a batch over a table of requests."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wicker.functions.text import html_to_text

MONEY = "decimal(20,6)"
NO_DATE = "0000-00-00 00:00:00"


@dataclass
class Catalog:
    """Shop tables and the scope they are read in."""

    product: DataFrame
    product_lang: DataFrame
    product_shop: DataFrame
    category_lang: DataFrame
    product_attribute: DataFrame
    product_attribute_shop: DataFrame
    stock: DataFrame
    attribute_of: DataFrame
    attribute: DataFrame
    attribute_lang: DataFrame
    group_lang: DataFrame
    shop_id: int = 1
    lang_id: int = 1


def _filled(c: str) -> Column:
    return F.when(F.trim(c) != "", F.trim(c))


def _texts(cat: Catalog) -> DataFrame:
    rows = cat.product_lang.filter((F.col("shop_id") == cat.shop_id) & (F.col("lang_id") == cat.lang_id))
    return rows.select("product_id", "name", "description_short", "description")


def catalog_products(cat: Catalog) -> DataFrame:
    """Products with texts, shop overrides and category; inactive ones stay."""
    shop = cat.product_shop.filter(F.col("shop_id") == cat.shop_id).select(
        "product_id", F.col("price").alias("shop_price"), F.col("available_for_order").alias("shop_orderable")
    )
    category = cat.category_lang.filter(
        (F.col("shop_id") == cat.shop_id) & (F.col("lang_id") == cat.lang_id)
    ).select("category_id", F.col("name").alias("category"))
    return (
        cat.product.join(_texts(cat), "product_id")
        .join(shop, "product_id", "left")
        .join(category, "category_id", "left")
        .select(
            "product_id",
            "name",
            _filled("reference").alias("product_reference"),
            F.col("description_short").alias("description"),
            "category",
            "active",
            F.coalesce("shop_orderable", "available_for_order").alias("available_for_order"),
            F.coalesce("shop_price", "price").cast(MONEY).alias("base_price_net"),
        )
    )


def catalog_combinations(cat: Catalog) -> DataFrame:
    """Variants with their reference and price impact (shop override first, else 0)."""
    shop = cat.product_attribute_shop.filter(F.col("shop_id") == cat.shop_id).select(
        "combination_id", F.col("price").alias("shop_price")
    )
    return cat.product_attribute.join(shop, "combination_id", "left").select(
        "product_id",
        "combination_id",
        _filled("reference").alias("combination_reference"),
        F.coalesce("shop_price", "price", F.lit(0)).cast(MONEY).alias("impact_net"),
        "default_on",
    )


def stock_scan(cat: Catalog, requests: DataFrame) -> DataFrame:
    """Stock rows of the shop for the requested products and combinations."""
    rows = cat.stock.filter(F.col("shop_id") == cat.shop_id)
    wanted = requests.select("product_id", "combination_id").distinct()
    return rows.join(wanted, ["product_id", "combination_id"], "left_semi").select(
        "product_id", "combination_id", "physical_quantity"
    )


def assemble_catalog(cat: Catalog, requests: DataFrame) -> DataFrame:
    """One row per request (product_id, combination_id with 0 = base).

    Unknown products and unknown combinations drop out. Without a stock row the
    quantity is NULL; a NULL quantity in a stock row counts as 0.
    """
    combinations = catalog_combinations(cat).drop("default_on")
    stock = stock_scan(cat, requests).select(
        "product_id", "combination_id", F.coalesce("physical_quantity", F.lit(0)).cast("double").alias("stock_quantity")
    )
    joined = (
        requests.join(catalog_products(cat), "product_id")
        .join(combinations.withColumn("__known", F.lit(True)), ["product_id", "combination_id"], "left")
        .filter((F.col("combination_id") == 0) | F.col("__known"))
        .join(stock, ["product_id", "combination_id"], "left")
    )
    return joined.select(
        *requests.columns,
        "name",
        "product_reference",
        "combination_reference",
        html_to_text(F.col("description")).alias("description"),
        _filled("category").alias("category"),
        "active",
        "available_for_order",
        "base_price_net",
        F.when(F.col("combination_id") == 0, F.lit(0).cast(MONEY)).otherwise(F.col("impact_net")).alias("impact_net"),
        "stock_quantity",
    )


def product_core(cat: Catalog, requests: DataFrame) -> DataFrame:
    """Active products among the requested ones."""
    wanted = requests.select("product_id").distinct()
    return (
        cat.product.filter(F.col("active"))
        .join(wanted, "product_id", "left_semi")
        .join(_texts(cat), "product_id")
        .select(
            "product_id",
            "name",
            _filled("reference").alias("sku"),
            html_to_text(F.col("description_short")).alias("short_description"),
            html_to_text(F.col("description")).alias("long_description"),
        )
    )


def combination_attributes(cat: Catalog) -> DataFrame:
    """(combination, group, value) rows with names of the language."""
    values = cat.attribute_lang.filter(F.col("lang_id") == cat.lang_id).select(
        "attribute_id", F.col("name").alias("value")
    )
    groups = cat.group_lang.filter(F.col("lang_id") == cat.lang_id).select("group_id", F.col("name").alias("group"))
    return (
        cat.attribute_of.join(cat.attribute, "attribute_id")
        .join(values, "attribute_id")
        .join(groups, "group_id")
        .select("combination_id", "group", "value")
    )


def variant_labels(cat: Catalog, combinations: DataFrame | None = None) -> DataFrame:
    """'group: value' pairs of a variant, in (group, value) order; of the given combinations, or of the whole shop."""
    pairs = combination_attributes(cat)
    if combinations is not None:
        pairs = pairs.join(combinations.select("combination_id").distinct(), "combination_id", "left_semi")
    pairs = pairs.distinct()
    return pairs.groupBy("combination_id").agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("group", "value"))),
                lambda p: F.concat(p["group"], F.lit(": "), p["value"]),
            ),
            " | ",
        ).alias("label")
    )


def variant_attributes(cat: Catalog, requests: DataFrame) -> DataFrame:
    """Attribute list of every variant of the requested products."""
    wanted = requests.select("product_id").distinct()
    variants = cat.product_attribute.join(wanted, "product_id", "left_semi").select("product_id", "combination_id")
    return (
        variants.join(combination_attributes(cat), "combination_id")
        .groupBy("product_id", "combination_id")
        .agg(F.sort_array(F.collect_list(F.struct("group", "value"))).alias("attributes"))
    )


def variants(cat: Catalog, requests: DataFrame) -> DataFrame:
    """Variants of active products that have a stock row, default variant first."""
    wanted = requests.select("product_id").distinct()
    active = cat.product.filter(F.col("active")).select("product_id").join(wanted, "product_id", "left_semi")
    stock = cat.stock.filter(F.col("shop_id") == cat.shop_id).select(
        "product_id", "combination_id", "physical_quantity"
    )
    quantity = F.coalesce("physical_quantity", F.lit(0))
    return (
        catalog_combinations(cat)
        .join(active, "product_id", "left_semi")
        .join(stock, ["product_id", "combination_id"])
        .join(variant_labels(cat, cat.product_attribute.join(wanted, "product_id", "left_semi")), "combination_id", "left")
        .select(
            "product_id",
            "combination_id",
            F.col("combination_reference").alias("sku"),
            "label",
            "impact_net",
            quantity.alias("physical_quantity"),
            (quantity > 0).alias("available"),
            (F.coalesce("default_on", F.lit(0)) == 1).alias("is_default"),
        )
    )


def default_variant(cat: Catalog, requests: DataFrame) -> DataFrame:
    """Lowest default variant of each requested active product."""
    wanted = requests.select("product_id").distinct()
    active = cat.product.filter(F.col("active")).select("product_id")
    return (
        cat.product_attribute.filter(F.col("default_on") == 1)
        .join(wanted, "product_id", "left_semi")
        .join(active, "product_id", "left_semi")
        .groupBy("product_id")
        .agg(F.min("combination_id").alias("combination_id"))
    )


def base_prices(cat: Catalog, requests: DataFrame) -> DataFrame:
    """Net price and variant impact per request; 0 where anything is missing."""
    shop = cat.product_shop.filter(F.col("shop_id") == cat.shop_id).select(
        "product_id", F.col("price").alias("shop_price")
    )
    product = (
        cat.product.filter(F.col("active"))
        .join(shop, "product_id", "left")
        .select("product_id", F.coalesce("shop_price", "price").cast(MONEY).alias("product_price"), F.lit(True).alias("__known"))
    )
    impact = catalog_combinations(cat).select("product_id", "combination_id", "impact_net")
    zero = F.lit(0).cast(MONEY)
    return (
        requests.join(product, "product_id", "left")
        .join(impact, ["product_id", "combination_id"], "left")
        .select(
            *requests.columns,
            F.coalesce("product_price", zero).alias("product_price"),
            F.when(F.col("__known"), F.coalesce("impact_net", zero)).otherwise(zero).alias("combination_impact"),
        )
    )


def stock_by_variant(cat: Catalog, requests: DataFrame) -> DataFrame:
    """Stock of the requested combination; a request without a row stays, unavailable."""
    stock = stock_scan(cat, requests).select(
        "product_id", "combination_id", F.coalesce("physical_quantity", F.lit(0)).alias("physical_quantity")
    )
    found = requests.join(stock, ["product_id", "combination_id"], "left")
    return found.withColumn("available", F.coalesce(F.col("physical_quantity") > 0, F.lit(False)))


def stock_by_product(cat: Catalog, requests: DataFrame) -> DataFrame:
    """All stock rows of the shop for the requested products."""
    wanted = requests.select("product_id").distinct()
    quantity = F.coalesce("physical_quantity", F.lit(0))
    return (
        cat.stock.filter(F.col("shop_id") == cat.shop_id)
        .join(wanted, "product_id", "left_semi")
        .select(
            "product_id", "combination_id", quantity.alias("physical_quantity"), (quantity > 0).alias("available")
        )
    )


CONTEXT = ["shop_id", "currency_id", "country_id", "group_id", "customer_id"]


def _in_range(requests: DataFrame) -> Column:
    """False for a rule that fits no request, as its quantity or a value of its context is above that of all of them.

    The highest values are one row however many requests there are, so they prune without a join.
    """
    highest = [F.greatest(F.max(c), F.lit(0)).alias(c) for c in CONTEXT]
    asked = requests.agg(F.struct(F.max("quantity").alias("quantity"), *highest).alias("asked")).scalar()
    fits = F.col("rule_from_quantity") <= asked["quantity"]
    for c in CONTEXT:
        fits = fits & (F.col(f"rule_{c}") <= asked[c])
    return fits


def price_rules_scoped(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules that may apply to a request: scope columns are 0 or equal, no cart, quantity reached.

    A rule's mask says which of its scope columns are 0. Each request is laid out
    once for every mask that occurs (at most 64), with 0 in the masked columns, so
    the join is on the product, the mask and all scope columns: a product with many
    rules and many customers meets only the rules that fit. Rules above the highest
    values asked for are dropped before they are shuffled. Rule columns come back with
    the prefix `rule_`.
    """
    scope = ["combination_id", *CONTEXT]
    renamed = rules.filter(F.col("cart_id") == 0).select(*[F.col(c).alias(f"rule_{c}") for c in rules.columns])
    renamed = renamed.filter(_in_range(requests))
    bits = [F.when(F.col(f"rule_{c}") == 0, F.lit(1 << k)).when(F.col(f"rule_{c}") != 0, F.lit(0)) for k, c in enumerate(scope)]
    renamed = renamed.withColumn("__mask", reduce(lambda a, b: a + b, bits))
    masks = renamed.agg(F.collect_set("__mask").alias("__masks"))  # one row
    wide = requests.crossJoin(F.broadcast(masks)).withColumn("__asked", F.explode("__masks")).drop("__masks")
    condition = (F.col("product_id") == F.col("rule_product_id")) & (F.col("__asked") == F.col("__mask"))
    for k, c in enumerate(scope):
        key = f"__key_{c}"
        free = F.col("__asked").bitwiseAND(F.lit(1 << k)) != 0
        wide = wide.withColumn(key, F.when(free, F.lit(0)).otherwise(F.col(c)))
        condition = condition & (F.col(key) == F.col(f"rule_{c}"))
    condition = condition & (F.col("rule_from_quantity") <= F.col("quantity"))
    helpers = ["__asked", "__mask", *[f"__key_{c}" for c in scope], "rule_product_id", "rule_cart_id"]
    return wide.join(renamed, condition).drop(*helpers)


def rule_date(c: str) -> Column:
    """Instant of a rule date; NULL for no date and for an unreadable one."""
    return F.when(F.col(c) != NO_DATE, F.col(c).try_cast("timestamp"))


def unreadable_date(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c) != NO_DATE) & rule_date(c).isNull()


def active_at(as_of: str) -> Column:
    """Date window of a scoped rule holds the instant, both ends included."""
    at = F.lit(as_of).cast("timestamp")
    start, end = rule_date("rule_valid_from"), rule_date("rule_valid_to")
    readable = ~unreadable_date("rule_valid_from") & ~unreadable_date("rule_valid_to")
    return readable & F.coalesce(start <= at, F.lit(True)) & F.coalesce(end >= at, F.lit(True))


def price_rules_valid(requests: DataFrame, rules: DataFrame, as_of: str) -> DataFrame:
    """Scoped rules whose date window holds `as_of`."""
    return price_rules_scoped(requests, rules).filter(active_at(as_of))

