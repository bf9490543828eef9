"""Availability, rule selection and prices: the commercial truth of a product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wicker.functions.cascade import codes, first_match
from wicker.functions.keys import beside
from wicker.functions.ranking import top_k
from wicker.session import stage_table
from wicker.sources import catalog as Cat

TAX = "0.19"
CURRENCY = "CLP"


def whole(c: Column) -> Column:
    """HALF_UP to a whole currency amount."""
    return F.round(c, 0).cast("decimal(15,0)")


def with_tax(net: Column, tax: str) -> Column:
    return net.cast("decimal(18,6)") * (F.lit(1).cast("decimal(6,4)") + F.lit(tax).cast("decimal(5,4)"))


# -- availability ----------------------------------------------------------


def availability(df: DataFrame) -> DataFrame:
    """Adds status, purchasable, stock_known and the whole stock quantity."""
    active, orderable, stock = F.col("active"), F.col("available_for_order"), F.col("stock_quantity")
    known = stock.isNotNull() & ~F.isnan(stock) & (F.abs(stock) != float("inf"))
    status = first_match(
        [
            (active == F.lit(False), "inactive"),
            (active.isNull() | orderable.isNull(), "unknown"),
            (~orderable, "unavailable_for_order"),
            (~known, "unknown"),
            (stock > 0, "available"),
        ],
        "out_of_stock",
    )
    truncated = F.when(stock >= 0, F.floor(stock)).otherwise(F.ceil(stock))
    return (
        df.withColumn("status", status)
        .withColumn("purchasable", F.col("status") == "available")
        .withColumn("stock_known", F.coalesce(known, F.lit(False)))
        .withColumn("stock_quantity", F.when(known, truncated.cast("bigint")))
    )


# -- rule selection --------------------------------------------------------


def _same(c: str) -> Column:
    return (F.col(f"rule_{c}") == F.col(c)).cast("int")


def _context_keys(requests: DataFrame) -> list[str]:
    return ["product_id", "combination_id", "quantity", *Cat.CONTEXT]


def _specificity() -> list[Column]:
    """Sort keys of the catalogue rule set, without the final id."""
    exact = (F.col("rule_combination_id") == F.col("combination_id")) & (F.col("combination_id") > 0)
    start = F.coalesce(F.unix_micros(Cat.rule_date("rule_valid_from")), F.lit(0).cast("bigint"))
    context = _same("currency_id") + _same("country_id") + _same("group_id") + _same("customer_id")
    return [exact.cast("int"), _same("shop_id"), F.col("rule_from_quantity"), context, start]


def select_price_rule(requests: DataFrame, rules: DataFrame, as_of: str, asked: DataFrame | None = None) -> DataFrame:
    """Best rule per request, with the warnings of the selection.

    Requests that share product and context are resolved once. The rules in scope
    are stored, for the best two and for the invalid dates. Two best rules per
    context come from a limited window, cut to two rows before the shuffle. `asked`
    has at least the contexts of the requests, where they are cheaper to read.
    """
    keys = _context_keys(requests)
    contexts = stage_table((requests if asked is None else asked).select(*keys).distinct(), "contexts")
    scoped = stage_table(Cat.price_rules_scoped(contexts, rules), "scoped-rules")
    usable = scoped.filter(Cat.active_at(as_of)).withColumn("score", F.struct(*_specificity()))
    best = top_k(usable, keys, [F.col("score").desc(), F.col("rule_id").desc()], 2, "place")
    chosen = [c for c in usable.columns if c.startswith("rule_")]
    at = lambda n, c: F.max(F.when(F.col("place") == n, F.col(c)))
    picked = (
        best.groupBy(*keys)
        .agg(
            *[at(1, c).alias(c) for c in chosen],
            F.when(at(1, "score") == at(2, "score"), at(2, "rule_id")).alias("ambiguous_with"),
        )
        .select(*keys, *chosen, "ambiguous_with")
    )
    unreadable = Cat.unreadable_date("rule_valid_from") | Cat.unreadable_date("rule_valid_to")
    invalid = scoped.filter(unreadable).groupBy(*keys).agg(F.count(F.lit(1)).alias("invalid_dates"))
    resolved = contexts.join(picked, keys, "left").join(invalid, keys, "left")
    return requests.join(resolved, keys, "left").withColumn(
        "invalid_dates", F.coalesce("invalid_dates", F.lit(0).cast("bigint"))
    )


# -- catalogue price -------------------------------------------------------


def commercial_price(df: DataFrame, tax: str = TAX, currency: str = CURRENCY) -> DataFrame:
    """Gross prices after the selected rule, plus price_warnings.

    Needs base_price_net, impact_net and the rule_ columns of a selection.
    """
    base = F.col("base_price_net") + F.col("impact_net")
    priced = base.isNotNull() & (base >= 0)
    rule = F.col("rule_id").isNotNull()
    net = F.when(rule & (F.col("rule_price") >= 0), F.col("rule_price") + F.col("impact_net")).otherwise(base)
    gross = whole(with_tax(F.greatest(net, F.lit(0).cast("decimal(20,6)")), tax))
    reduction = F.col("rule_reduction").cast("decimal(12,6)")
    cut = rule & (reduction > 0)
    percentage = cut & (F.col("rule_reduction_type") == "percentage")
    amount = cut & (F.col("rule_reduction_type") == "amount")
    other = cut & ~F.col("rule_reduction_type").isin("percentage", "amount")
    fits = percentage & (reduction <= 1)
    zero = F.lit(0).cast("decimal(15,0)")
    df = df.withColumn("base_gross", F.when(priced, gross)).withColumn("__cut", F.when(amount, whole(reduction)))
    base_gross = F.col("base_gross")
    final = (
        F.when(fits, whole(base_gross * (F.lit(1).cast("decimal(12,6)") - reduction)))
        .when(amount, F.greatest(base_gross - F.col("__cut"), zero))
        .otherwise(base_gross)
    )
    warnings = codes(
        [
            (~priced, "CATALOG_INVALID_BASE_PRICE"),
            (~priced, "CATALOG_PRICE_UNAVAILABLE"),
            (priced & ((percentage & (reduction > 1)) | (rule & (reduction < 0))), "SPECIFIC_PRICE_INVALID_REDUCTION"),
            (priced & amount & (F.col("__cut") > base_gross), "SPECIFIC_PRICE_EXCEEDS_BASE_PRICE"),
            (priced & other, "SPECIFIC_PRICE_UNSUPPORTED_REDUCTION_TYPE"),
        ]
    )
    return (
        df.withColumn("final_gross", F.when(priced, final).cast("bigint"))
        .withColumn("price_warnings", warnings)
        .withColumn("discount_type", F.when(priced & fits, F.lit("percentage")).when(priced & amount, F.lit("amount")))
        .withColumn(
            "discount_value",
            F.when(priced & fits, reduction.cast("double")).when(priced & amount, F.col("__cut").cast("double")),
        )
        .withColumn("base_gross", base_gross.cast("bigint"))
        .withColumn("discount_applied", F.col("final_gross") < F.col("base_gross"))
        .withColumn("specific_price_id", F.when(priced, F.col("rule_id")))
        .withColumn("currency", F.when(priced, F.lit(currency)))
        .drop("__cut")
    )


# -- commercial truth ------------------------------------------------------


def normalise_references(requests: DataFrame) -> DataFrame:
    """Valid references only, once each, with numeric ids; combination 0 is the base.

    A repeat adds nothing, so a distinct keeps the same set as keep-first.
    """
    digits = F.col("product_id").rlike("^[0-9]+$") & (
        F.col("combination_id").isNull() | F.col("combination_id").rlike("^[0-9]+$")
    )
    combination = F.when(F.col("combination_id") != "0", F.col("combination_id"))
    return (
        requests.filter(digits)
        .select("product_id", combination.alias("combination_id"))
        .withColumn("pid", F.col("product_id").try_cast("bigint"))
        .withColumn("cid", F.coalesce(F.col("combination_id").try_cast("bigint"), F.lit(0).cast("bigint")))
        .filter(F.col("pid") > 0)
        .distinct()
    )


def commercial_truth(
    requests: DataFrame, cat: Cat.Catalog, rules: DataFrame, context: dict[str, int], as_of: str, tax: str = TAX
) -> DataFrame:
    """Availability, price and warnings of every requested reference that resolves."""
    wanted = normalise_references(requests).select(
        F.col("product_id").alias("ref_product"),
        F.col("combination_id").alias("ref_combination"),
        F.col("pid").alias("product_id"),
        F.col("cid").alias("combination_id"),
        *[F.lit(v).cast("bigint").alias(k) for k, v in context.items()],
    )
    assembled = availability(Cat.assemble_catalog(cat, wanted))
    # the references themselves: the catalogue is put together once, for the result
    selected = select_price_rule(assembled, rules, as_of, wanted)
    priced = commercial_price(selected, tax)
    warnings = F.concat(
        F.array_repeat(F.lit("SPECIFIC_PRICE_INVALID_DATE"), F.col("invalid_dates").cast("int")),
        codes(
            [
                (F.col("ambiguous_with").isNotNull(), "SPECIFIC_PRICE_SELECTION_AMBIGUOUS"),
                (F.col("status") == "unknown", "CATALOG_COMMERCIAL_STATUS_UNKNOWN"),
            ]
        ),
        F.col("price_warnings"),
    )
    return priced.select(
        F.col("ref_product").alias("product_id"),
        F.col("ref_combination").alias("combination_id"),
        "name",
        F.coalesce("combination_reference", "product_reference").alias("reference"),
        "description",
        "category",
        F.coalesce(F.col("active"), F.lit(False)).alias("active"),
        F.coalesce(F.col("available_for_order"), F.lit(False)).alias("available_for_order"),
        "status",
        "purchasable",
        "stock_known",
        "stock_quantity",
        "base_gross",
        "final_gross",
        "currency",
        "discount_applied",
        "discount_type",
        "discount_value",
        "specific_price_id",
        warnings.alias("warnings"),
    )


def truth_stats(requests: DataFrame, truth: DataFrame) -> DataFrame:
    """Eight counters, one row."""
    requested = normalise_references(requests).agg(F.count(F.lit(1)).alias("requested"))
    counted = truth.agg(
        F.count(F.lit(1)).alias("resolved"),
        F.count_if(F.col("status") == "inactive").alias("inactive"),
        F.count_if(F.col("status") == "unavailable_for_order").alias("unavailable_for_order"),
        F.count_if(F.col("status") == "out_of_stock").alias("out_of_stock"),
        F.count_if(F.col("final_gross").isNull()).alias("price_unavailable"),
        F.coalesce(F.sum(F.size("warnings")), F.lit(0).cast("bigint")).alias("warnings_generated"),
    )
    return beside(requested, counted).withColumn("missing", F.col("requested") - F.col("resolved"))


# -- quotes: the second rule set -------------------------------------------


def price_quote(requests: DataFrame, cat: Cat.Catalog, rules: DataFrame, as_of: str, tax: str = TAX) -> DataFrame:
    """Unit price, subtotal and discount of each request.

    Other keys and other arithmetic than the catalogue price, on purpose:
    discounts act on the net price and the lowest rule id wins.
    """
    keys = _context_keys(requests)
    contexts = requests.select(*keys).distinct()
    order = [
        *[_same(c).desc() for c in ["combination_id", *Cat.CONTEXT]],
        F.col("rule_from_quantity").desc(),
        F.coalesce("rule_priority", F.lit(0)).desc(),
        F.col("rule_id").asc(),
    ]
    best = top_k(Cat.price_rules_valid(contexts, rules, as_of), keys, order, 1, "place").drop("place")
    priced = Cat.base_prices(cat, contexts).join(best, keys, "left")
    factor = F.lit(1).cast("decimal(6,4)") + F.lit(tax).cast("decimal(5,4)")
    zero = F.lit(0).cast("decimal(20,6)")
    catalog_net = F.greatest(F.col("product_price") + F.col("combination_impact"), zero)
    net = F.when(F.col("rule_price") >= 0, F.col("rule_price") + F.col("combination_impact")).otherwise(catalog_net)
    reduction = F.col("rule_reduction").cast("decimal(12,6)")
    percentage = (reduction > 0) & (F.col("rule_reduction_type") == "percentage")
    amount = (reduction > 0) & (F.col("rule_reduction_type") == "amount")
    taxed = F.col("rule_reduction_tax") == 1
    net = net.cast("decimal(18,6)")
    # a tax-included amount comes off the gross price: (net - r / f) * f = net * f - r
    gross = (
        F.when(percentage, (net * (F.lit(1).cast("decimal(12,6)") - reduction)).cast("decimal(24,10)") * factor)
        .when(amount & taxed, net * factor - reduction)
        .when(amount, (net - reduction).cast("decimal(20,6)") * factor)
        .otherwise(net * factor)
    )
    unit = whole(F.greatest(gross, zero)).cast("bigint")
    value = (
        F.when(percentage, F.round(reduction, 4).cast("double"))
        .when(amount & taxed, whole(reduction.cast("decimal(18,6)") / factor).cast("double"))
        .when(amount, whole(reduction).cast("double"))
    )
    quoted = priced.select(
        *keys,
        whole(catalog_net.cast("decimal(18,6)") * factor).cast("bigint").alias("base_unit_price"),
        unit.alias("unit_price"),
        F.when(percentage, F.lit("percentage")).when(amount, F.lit("amount")).alias("discount_type"),
        value.alias("discount_value"),
        F.col("rule_id").alias("specific_price_id"),
    )
    return (
        requests.join(quoted, keys)
        .withColumn("subtotal", F.col("unit_price") * F.col("quantity"))
        .withColumn("discount_applied", F.col("unit_price") < F.col("base_unit_price"))
    )


def price_parity(expected: DataFrame, quotes: DataFrame) -> DataFrame:
    """Cases whose quote differs from the expected price, or has none."""
    keys = ["product_id", "combination_id", "quantity"]
    actual = quotes.select(*keys, F.col("unit_price").alias("actual_price")).distinct()
    return expected.join(actual, keys, "left").filter(
        ~F.col("expected_price").eqNullSafe(F.col("actual_price"))
    )


