"""Affinity of identified customers to products.

`requests`: batch_id, seq, customer_id (NULL = not identified), product_id,
combination_id. Evidence is one wide row per (customer, product), made either
from given evidence rows or from the purchase and interest history.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wicker.functions.keys import join_on, sealed, unsealed
from wicker.functions.ranking import mark_repeats
from wicker.params import AffinityParams
from wicker.session import stage_table

ITEM = ["product_id", "combination_id"]
# evidence member -> (signal, divisor)
COUNTED = {
    "direct": ("DIRECT_PRODUCT_PURCHASE", 3),
    "category": ("CATEGORY_PURCHASE", 5),
    "brand": ("BRAND_PURCHASE", 5),
    "product_interest": ("RECENT_PRODUCT_INTEREST", 3),
    "category_interest": ("RECENT_CATEGORY_INTEREST", 3),
    "product_rejection": ("PRODUCT_REJECTION", 1),
    "category_rejection": ("CATEGORY_REJECTION", 1),
    "owned_compatible": ("OWNED_COMPATIBLE_PRODUCT", 2),
}
SIGNALS = [s for s, _ in COUNTED.values()] + ["REPEAT_PURCHASE_PATTERN", "OBSERVED_SPEND_FIT"]
NEGATIVE = ("PRODUCT_REJECTION", "CATEGORY_REJECTION")


def identified(customer: str = "customer_id") -> Column:
    """Customer ids that are not blank and not a placeholder."""
    c = F.lower(F.trim(F.col(customer)))
    return F.coalesce((c != "") & ~c.isin("0", "unknown"), F.lit(False))


def in_window(at: str, ref_time: str | None, days: int) -> Column:
    if ref_time is None:
        return F.lit(False)
    ref = F.lit(ref_time).cast("timestamp")
    return F.coalesce(
        (F.col(at) <= ref) & (F.col(at) >= ref - F.expr(f"INTERVAL '{days}' DAY")), F.lit(False)
    )


def _counts(name: str, when: Column, keep: Column) -> list[Column]:
    """Count, latest time and presence of one evidence member."""
    use = when & keep
    return [
        F.sum(F.when(use, F.coalesce("cnt", F.lit(1)))).cast("bigint").alias(f"{name}_count"),
        F.max(F.when(use, F.col("occurred_at"))).alias(f"{name}_last"),
        F.max(when).alias(f"{name}_any"),
    ]


def _keep(name: str, ref_time: str | None, p: AffinityParams) -> Column:
    if name.endswith("_interest"):
        return in_window("occurred_at", ref_time, p.interest_days)
    if name.endswith("_rejection") and ref_time is not None:
        return in_window("occurred_at", ref_time, p.rejection_days)
    return F.lit(True)


def evidence_from_rows(rows: DataFrame, ref_time: str | None, p: AffinityParams = AffinityParams()) -> DataFrame:
    """Given evidence (customer, product, kind, cnt, occurred_at, ...) to wide rows.

    Kinds are the names in COUNTED, and `repeat` (cnt = purchase count), and
    `price` (candidate_price, currency). Where a row of a customer and product has
    a negative or fractional count, an unknown kind or a price that is no amount,
    all evidence of the two is left out and `invalid_evidence` is set.
    """
    kind, price_value = F.col("kind"), F.col("candidate_price")
    number = F.col("cnt").cast("double")
    wrong = (
        ~kind.isin(*COUNTED, "repeat", "price")
        | (number < 0)
        | (number != F.floor(number))
        | (price_value < 0)
        | F.isnan(price_value)
        | (price_value == float("inf"))
    )
    members = [c for name in COUNTED for c in _counts(name, kind == name, _keep(name, ref_time, p))]
    repeat, price = kind == "repeat", kind == "price"
    found = rows.groupBy("customer_id", *ITEM).agg(
        F.coalesce(F.bool_or(wrong), F.lit(False)).alias("invalid_evidence"),
        *members,
        F.max(F.when(repeat, F.col("cnt"))).cast("bigint").alias("repeat_count"),
        F.max(F.when(repeat, F.col("occurred_at"))).alias("repeat_last"),
        F.max(F.when(repeat, F.col("median_interval_days"))).alias("repeat_median_days"),
        F.max(F.when(price, F.col("candidate_price"))).alias("candidate_price"),
        F.max(F.when(price, F.col("currency"))).alias("candidate_currency"),
    )
    values = [c for c in found.columns if c not in ("customer_id", *ITEM, "invalid_evidence")]
    return found.withColumns({c: F.when(~F.col("invalid_evidence"), F.col(c)) for c in values})


def daily_history(known: DataFrame, ref_time: str | None, p: AffinityParams) -> DataFrame:
    """What a customer did with a product on one day: a row for each customer, product and day.

    All evidence is made of these rows. Purchases shrink to distinct days first, so a
    group is bounded by the calendar and not by the number of purchases.
    """
    action = F.col("action")
    members = {"direct": action == "purchase", "product_interest": action == "interest", "product_rejection": action == "rejection"}
    aggs = []
    for name, when in members.items():
        use = when & _keep(name, ref_time, p)
        aggs += [
            F.sum(F.when(use, F.coalesce("cnt", F.lit(1)))).alias(f"{name}_count"),
            F.max(F.when(use, F.col("occurred_at"))).alias(f"{name}_last"),
            F.max(when).alias(f"{name}_any"),
        ]
    return known.groupBy("customer_id", sealed().alias("item"), F.to_date("occurred_at").alias("day")).agg(*aggs)


def _summed(daily: DataFrame, keys: Sequence[str], members: dict[str, str], *more: Column) -> DataFrame:
    """Sums of daily history; `members` maps evidence members to those of the days."""
    aggs = [
        c
        for name, own in members.items()
        for c in (
            F.sum(f"{own}_count").cast("bigint").alias(f"{name}_count"),
            F.max(f"{own}_last").alias(f"{name}_last"),
            F.max(f"{own}_any").alias(f"{name}_any"),
        )
    ]
    return daily.groupBy("customer_id", *keys).agg(*aggs, *more)


def with_gaps(daily: DataFrame) -> DataFrame:
    """Adds to every day with a purchase the days since the one before."""
    bought = F.coalesce("direct_any", F.lit(False))
    before = Window.partitionBy("customer_id", "item").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(bought, F.col("day")), ignorenulls=True).over(before)
    return daily.withColumn("gap", F.when(bought, F.date_diff("day", last)))


def evidence_from_history(
    pairs: DataFrame,
    behaviour: DataFrame,
    products: DataFrame,
    compatible: DataFrame,
    ref_time: str | None,
    p: AffinityParams = AffinityParams(),
) -> DataFrame:
    """Wide evidence of the asked (customer, product) pairs out of history.

    `behaviour`: customer, product, action (purchase | interest | rejection),
    cnt, occurred_at. `products`: category, brand, price, currency. `compatible`:
    product and compatible product. The history of the asked customers is read once,
    summed per customer, product and day, and stored; what it says of products,
    categories, brands and purchase days comes from there.
    """
    asked = pairs.select("customer_id", sealed().alias("item")).distinct()
    known = behaviour.join(asked.select("customer_id").distinct(), "customer_id", "left_semi")
    daily = stage_table(daily_history(known, ref_time, p), "history")
    facts = products.select(
        sealed().alias("item"), "category", "brand", F.col("price").alias("candidate_price"), F.col("currency").alias("candidate_currency")
    )
    by_product = _summed(
        with_gaps(daily),
        ["item"],
        {n: n for n in ("direct", "product_interest", "product_rejection")},
        F.nullif(F.count_if("direct_any"), F.lit(0)).alias("repeat_count"),
        F.max(F.when(F.col("direct_any"), F.col("direct_last"))).alias("repeat_last"),
        F.median("gap").alias("repeat_median_days"),
    )
    described = daily.join(facts.select("item", "category", "brand"), "item")
    of_category = {"category": "direct", "category_interest": "product_interest", "category_rejection": "product_rejection"}
    by_category = _summed(described.filter(F.col("category").isNotNull()), ["category"], of_category)
    by_brand = _summed(described.filter(F.col("direct_any") & F.col("brand").isNotNull()), ["brand"], {"brand": "direct"})
    edges = compatible.select(
        sealed().alias("item"), sealed("compatible_product_id", "compatible_combination_id").alias("owned_item")
    )
    owned = daily.filter(F.col("direct_any")).groupBy("customer_id", F.col("item").alias("owned_item")).agg(F.max("direct_last").alias("occurred_at"))
    compatible_owned = (
        owned.join(edges, "owned_item")
        .groupBy("customer_id", "item")
        .agg(
            F.count(F.lit(1)).alias("owned_compatible_count"),
            F.max("occurred_at").alias("owned_compatible_last"),
            F.lit(True).alias("owned_compatible_any"),
        )
    )
    wide = asked.join(by_product, ["customer_id", "item"], "left").join(compatible_owned, ["customer_id", "item"], "left")
    wide = wide.join(facts, "item", "left")
    wide = wide.join(by_category, ["customer_id", "category"], "left").join(by_brand, ["customer_id", "brand"], "left")
    some = reduce(
        lambda a, b: a | b, [F.coalesce(f"{name}_any", F.lit(False)) for name in COUNTED] + [F.col("repeat_count").isNotNull()]
    )
    rest = [c for c in wide.columns if c not in ("customer_id", "item", "category", "brand")]
    return wide.filter(some).select("customer_id", *unsealed("item"), *rest)


def no_evidence(keys: DataFrame) -> DataFrame:
    """Wide evidence without a row, for runs whose evidence cannot be read."""
    types = {"count": "bigint", "last": "timestamp", "any": "boolean"}
    columns = {f"{n}_{part}": F.lit(None).cast(t) for n in COUNTED for part, t in types.items()}
    columns |= {
        "repeat_count": F.lit(None).cast("bigint"),
        "repeat_last": F.lit(None).cast("timestamp"),
        "repeat_median_days": F.lit(None).cast("double"),
        "candidate_price": F.lit(None).cast("double"),
        "candidate_currency": F.lit(None).cast("string"),
    }
    return keys.select("customer_id", *ITEM).filter(F.lit(False)).withColumns(columns)


def customer_profile(orders: DataFrame) -> DataFrame:
    """Observed spend per customer and currency."""
    return orders.groupBy("customer_id", "currency").agg(
        F.min("amount").alias("min_spend"),
        F.max("amount").alias("max_spend"),
        F.avg("amount").alias("avg_spend"),
        F.count(F.lit(1)).alias("order_count"),
    )


def with_signals(
    evidence: DataFrame, profile: DataFrame, ref_time: str | None, p: AffinityParams = AffinityParams()
) -> DataFrame:
    """Adds strength, count and latest time per signal, and warnings.

    `profile` has one row per customer and currency. A price is held against the
    spend in its own currency; a customer who never paid in it is a mismatch.
    """
    spend = profile.select("customer_id", F.col("currency").alias("candidate_currency"), "max_spend", "avg_spend", F.lit(True).alias("__same"))
    known = profile.select("customer_id", F.lit(True).alias("__known")).distinct()
    df = evidence.join(known, "customer_id", "left").join(spend, ["customer_id", "candidate_currency"], "left")
    price, comparable = F.col("candidate_price"), F.coalesce("__same", F.lit(False))
    has_profile = F.coalesce("__known", F.lit(False))
    fit = F.when(price.isNotNull() & comparable & (price <= F.col("max_spend")), F.lit(1.0)).when(
        price.isNotNull() & comparable & (price <= F.col("avg_spend")), F.lit(0.8)
    )
    columns: dict[str, Column] = {}
    for name, (signal, divisor) in COUNTED.items():
        count = F.col(f"{name}_count")
        columns[f"s_{signal}"] = F.when(count > 0, F.least(F.lit(1.0), count / F.lit(float(divisor))))
        columns[f"n_{signal}"] = F.when(count > 0, count)
        columns[f"t_{signal}"] = F.when(count > 0, F.col(f"{name}_last"))
    repeated = F.col("repeat_count") >= 2
    columns["s_REPEAT_PURCHASE_PATTERN"] = F.when(repeated, F.least(F.lit(1.0), F.col("repeat_count") / F.lit(5.0)))
    columns["n_REPEAT_PURCHASE_PATTERN"] = F.when(repeated, F.col("repeat_count"))
    columns["t_REPEAT_PURCHASE_PATTERN"] = F.when(repeated, F.col("repeat_last"))
    columns["s_OBSERVED_SPEND_FIT"] = fit
    columns["n_OBSERVED_SPEND_FIT"] = F.when(fit.isNotNull(), F.lit(1).cast("bigint"))
    columns["t_OBSERVED_SPEND_FIT"] = F.lit(None).cast("timestamp")
    missing_time = F.lit(ref_time is None)
    invalid = F.col("invalid_evidence") if "invalid_evidence" in evidence.columns else F.lit(False)
    warnings = F.array_compact(
        F.array(
            F.when(invalid, F.lit("INVALID_EVIDENCE_IGNORED")),
            F.when(missing_time & F.col("product_interest_any"), F.lit("REFERENCE_TIME_UNAVAILABLE")),
            F.when(missing_time & F.col("category_interest_any"), F.lit("REFERENCE_TIME_UNAVAILABLE")),
            F.when(price.isNotNull() & ~has_profile, F.lit("SPEND_PROFILE_UNAVAILABLE")),
            F.when(price.isNotNull() & F.col("candidate_currency").isNotNull() & has_profile & ~comparable, F.lit("CURRENCY_MISMATCH")),
        )
    )
    kept = ["customer_id", *ITEM, "repeat_median_days"]
    return df.select(*kept, *[c.alias(n) for n, c in columns.items()], warnings.alias("affinity_warnings"))


def signal_rows(signals: DataFrame) -> DataFrame:
    """One row per signal that fired."""
    entries = [
        F.when(
            F.col(f"s_{s}").isNotNull(),
            F.struct(
                F.lit(s).alias("code"),
                F.lit("negative" if s in NEGATIVE else "positive").alias("direction"),
                F.col(f"s_{s}").alias("strength"),
                F.col(f"n_{s}").alias("evidence_count"),
                F.col(f"t_{s}").alias("most_recent_at"),
            ),
        )
        for s in SIGNALS
    ]
    return signals.select("customer_id", *ITEM, F.explode(F.array_compact(F.array(*entries))).alias("signal")).select(
        "customer_id", *ITEM, "signal.*"
    )


def with_score(signals: DataFrame, p: AffinityParams = AffinityParams()) -> DataFrame:
    """Adds affinity_score in 0..1, confidence and the signal counts."""
    strength = lambda s: F.coalesce(F.col(f"s_{s}"), F.lit(0.0))
    plus = reduce(lambda a, b: a + b, [strength(s) * F.lit(w) for s, w in p.positive_weights().items()])
    minus = reduce(lambda a, b: a + b, [strength(s) * F.lit(w) for s, w in p.penalties().items()])
    weight = sum(p.positive_weights().values())
    kinds = reduce(lambda a, b: a + b, [F.col(f"s_{s}").isNotNull().cast("int") for s in SIGNALS])
    pieces = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"n_{s}"), F.lit(0)) for s in SIGNALS])
    negatives = reduce(lambda a, b: a + b, [F.col(f"s_{s}").isNotNull().cast("int") for s in NEGATIVE])
    n, e = F.col("signal_types"), F.col("evidence_count")
    confidence = (
        F.when((n == 0) | (e == 0), "none")
        .when((n >= 3) & (e >= p.evidence_for_high), "high")
        .when((n >= 2) & (e >= p.evidence_for_medium), "medium")
        .otherwise("low")
    )
    return (
        signals.withColumn(
            "affinity_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (plus - minus) / F.lit(weight)))
        )
        .withColumn("signal_types", kinds)
        .withColumn("negative_signals", negatives)
        .withColumn("evidence_count", pieces)
        .withColumn("confidence", confidence)
    )


def mark_request_repeats(requests: DataFrame) -> DataFrame:
    """Adds `repeat`: the product was asked for earlier in the same batch."""
    return mark_repeats(requests, ["batch_id", *ITEM], ["seq"], "repeat")


def affinity_table(requests: DataFrame, scored: DataFrame) -> DataFrame:
    """One row per asked product: score, confidence and coverage warnings.

    Unidentified customers and products without evidence get neutral rows.
    """
    asked = mark_request_repeats(requests).filter(~F.col("repeat")).drop("repeat")
    asked = asked.withColumn("known_customer", identified())
    evidence = scored.withColumn("has_evidence", F.lit(True))
    found = join_on(asked, evidence, ["customer_id", *ITEM], "left").withColumn(
        "has_evidence", F.coalesce(F.col("has_evidence") & F.col("known_customer"), F.lit(False))
    )
    coverage = found.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("batch_products"), F.count_if("has_evidence").alias("batch_with_evidence")
    )
    table = found.join(coverage, "batch_id")
    has, known, some = F.col("has_evidence"), F.col("known_customer"), F.col("batch_with_evidence") > 0
    missing = F.when(known & ~has & some, F.array(F.lit("PARTIAL_CUSTOMER_HISTORY"))).when(
        known & ~has, F.array(F.lit("NO_CUSTOMER_HISTORY"))
    )
    batch_warning = (
        F.when(~known, "CUSTOMER_NOT_IDENTIFIED")
        .when(~some, "NO_CUSTOMER_HISTORY")
        .when(F.col("batch_with_evidence") < F.col("batch_products"), "PARTIAL_CUSTOMER_HISTORY")
    )
    empty = F.array().cast("array<string>")
    neutral = {
        "affinity_score": F.lit(0.0),
        "confidence": F.lit("none"),
        "signal_types": F.lit(0),
        "negative_signals": F.lit(0),
        "evidence_count": F.lit(0).cast("bigint"),
    }
    strengths = [F.when(has, F.col(f"s_{s}")).alias(f"s_{s}") for s in SIGNALS]
    return table.select(
        "batch_id",
        "seq",
        "customer_id",
        *ITEM,
        "known_customer",
        "has_evidence",
        *[F.when(has, F.col(c)).otherwise(v).alias(c) for c, v in neutral.items()],
        *strengths,
        F.when(has, F.col("affinity_warnings")).otherwise(F.coalesce(missing, empty)).alias("affinity_warnings"),
        batch_warning.alias("batch_warning"),
    )


def batch_warnings(table: DataFrame, provider: DataFrame | None = None) -> DataFrame:
    """(batch_id, position, code): a code for each warning of the evidence source, then the batch's own warning.

    `table` is an affinity table, `provider` has one row (batch_id) for each warning that
    came with the evidence. The source is not asked for customers who are not
    identified, so its warnings do not count there.
    """
    own = table.groupBy("batch_id").agg(F.max("batch_warning").alias("own"), F.bool_or("known_customer").alias("asked"))
    if provider is None:
        given = own.select("batch_id", F.lit(0).cast("bigint").alias("n"))
    else:
        given = provider.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))
    both = own.join(given, "batch_id", "left")
    n = F.when(F.col("asked"), F.coalesce("n", F.lit(0))).otherwise(F.lit(0)).cast("int")
    codes_ = F.concat(F.array_repeat(F.lit("AFFINITY_PROVIDER_WARNING"), n), F.array_compact(F.array("own")))
    listed = both.select("batch_id", F.posexplode(codes_).alias("place", "code"))
    return listed.select("batch_id", (F.col("place") + 1).alias("position"), "code")


def evidence_checks(requests: DataFrame, evidence: DataFrame) -> DataFrame:
    """Violations of a provided evidence table (batch_id, customer_id, product).

    Batches have one customer each.
    """
    batches = requests.select("batch_id", F.col("customer_id").alias("__asked")).distinct()
    other = evidence.join(batches, "batch_id").filter(~F.col("customer_id").eqNullSafe(F.col("__asked")))
    keyed = evidence.groupBy("batch_id", *ITEM).agg(F.count(F.lit(1)).alias("n"))
    outside = join_on(keyed, requests.select("batch_id", *ITEM).distinct(), ["batch_id", *ITEM], "left_anti")
    zero = F.lit(0).cast("bigint")
    one = lambda df, check, c: df.agg(F.coalesce(c, zero).alias("violations")).select(F.lit(check).alias("check"), "violations")
    return (
        one(other, "DIFFERENT_CUSTOMER", F.count(F.lit(1)))
        .unionByName(one(keyed, "DUPLICATE_PRODUCT", F.sum(F.col("n") - 1)))
        .unionByName(one(outside, "OUTSIDE_BATCH", F.sum("n")))
    )


def affinity_stats(requests: DataFrame, table: DataFrame) -> DataFrame:
    """Nine counters per batch."""
    asked = requests.groupBy("batch_id").agg(F.count(F.lit(1)).alias("requested_products"))
    positive = F.col("signal_types") - F.col("negative_signals")
    counted = table.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("deduplicated_products"),
        F.count_if("has_evidence").alias("products_with_evidence"),
        F.sum(positive).cast("bigint").alias("positive_signals_generated"),
        F.sum("negative_signals").cast("bigint").alias("negative_signals_generated"),
        (F.sum(F.size("affinity_warnings")) + F.max(F.col("batch_warning").isNotNull().cast("int"))).cast("bigint").alias(
            "warnings_generated"
        ),
        F.max(F.col("known_customer").cast("int")).alias("provider_calls"),
    )
    joined = asked.join(counted, "batch_id")
    return joined.withColumn(
        "duplicate_products_removed", F.col("requested_products") - F.col("deduplicated_products")
    ).withColumn("products_without_evidence", F.col("deduplicated_products") - F.col("products_with_evidence"))
