"""Catalogue search: candidates by reference, name or text, match score, top-k.

`queries`: query_id, query, limit, include_out_of_stock. `items`: one row per
product and variant (product_id, combination_id, product_sku, combination_sku,
product_name, short_description, long_description, variant_label,
physical_quantity, has_variants, is_default).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wicker.functions.text import html_to_text, strip_accents
from wicker.operators.pricing import price_quote
from wicker.session import stage_table
from wicker.sources import catalog as Cat

GRAM = 3
TEXTS = ["product_name", "short_description", "long_description"]
VARIANT = ["combination_id", "sku", "label", "attributes", "impact_net", "physical_quantity", "available", "is_default"]
ATTRIBUTES = "array<struct<group:string,value:string>>"


def search_items(cat: Cat.Catalog) -> DataFrame:
    """Active products by variant (or alone), with stock, label and default flag."""
    core = (
        cat.product.filter(F.col("active"))
        .join(
            cat.product_lang.filter((F.col("shop_id") == cat.shop_id) & (F.col("lang_id") == cat.lang_id)),
            "product_id",
        )
        .select(
            "product_id",
            F.trim("reference").alias("product_sku"),
            F.col("name").alias("product_name"),
            F.col("description_short").alias("short_description"),
            F.col("description").alias("long_description"),
        )
    )
    variants = Cat.catalog_combinations(cat).select(
        "product_id",
        "combination_id",
        F.col("combination_reference").alias("combination_sku"),
        "default_on",
        F.lit(True).alias("__variant"),
    )
    stock = cat.stock.filter(F.col("shop_id") == cat.shop_id).select(
        "product_id", "combination_id", "physical_quantity"
    )
    joined = (
        core.join(variants, "product_id", "left")
        .withColumn("combination_id", F.coalesce("combination_id", F.lit(0).cast("bigint")))
        .join(stock, ["product_id", "combination_id"], "left")
        .join(Cat.variant_labels(cat), "combination_id", "left")
    )
    return joined.select(
        "product_id",
        "combination_id",
        F.when(F.col("product_sku") != "", F.col("product_sku")).alias("product_sku"),
        "combination_sku",
        *TEXTS,
        F.col("label").alias("variant_label"),
        F.coalesce("physical_quantity", F.lit(0)).alias("physical_quantity"),
        F.col("__variant").isNotNull().alias("has_variants"),
        F.coalesce("default_on", F.lit(0)).alias("is_default"),
        "default_on",
    )


def _grams(text: Column, size: int) -> Column:
    """Distinct substrings of one length."""
    last = F.length(text) - (size - 1)
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))


def text_matches(terms: DataFrame, texts: DataFrame) -> DataFrame:
    """(term, text) pairs where the text contains the term, ignoring case.

    An inverted index over substrings replaces the all-against-all test: each
    term looks up its rarest substring and the few texts found are verified.
    Terms shorter than a full substring use shorter ones. Columns: `term`,
    `text`, both lower case and distinct.
    """
    width = F.least(F.length("term"), F.lit(GRAM))
    sized = terms.filter(F.col("term") != "").withColumn("__w", width)
    keys = sized.select(
        "term",
        F.explode(
            F.when(F.col("__w") == 1, _grams(F.col("term"), 1))
            .when(F.col("__w") == 2, _grams(F.col("term"), 2))
            .otherwise(_grams(F.col("term"), GRAM))
        ).alias("gram"),
    )
    # only substrings that some term asks for enter the index
    asked = keys.select("gram").distinct()
    # an index row holds a hash of its text; the text itself comes back for the rows that are found
    named = stage_table(texts.select(F.xxhash64("text").alias("tid"), "text"), "texts")
    lengths = sorted(r["__w"] for r in sized.select("__w").distinct().collect()) or [GRAM]  # at most GRAM numbers
    postings = named.select("tid", F.explode(F.concat(*[_grams(F.col("text"), n) for n in lengths])).alias("gram"))
    # read for the frequencies and again for the rarest substrings
    postings = stage_table(postings.join(asked, "gram", "left_semi"), "postings")
    frequency = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # a substring without postings proves that its term matches nothing
    rarest = (
        keys.join(frequency, "gram", "left")
        .groupBy("term")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("gram").alias("gram"))).alias("best"))
        .filter(F.col("best.n") > 0)
        .select("term", F.col("best.gram").alias("gram"))
    )
    found = rarest.join(postings, "gram").select("term", "tid").distinct().join(named, "tid")
    return found.filter(F.contains("text", "term")).select("term", "text")


def fold(c: Column | str) -> Column:
    """Text as the shop database compares it: no case, no accents."""
    return F.lower(strip_accents(F.col(c) if isinstance(c, str) else c))


@dataclass(frozen=True)
class Pool:
    """A cut before scoring: at most max(factor * limit, least) matches of a query, by the least product ids."""

    factor: int = 10
    least: int = 50


# what the shop's own search applies
SHOP_POOL = Pool()


def search_candidates(queries: DataFrame, items: DataFrame, pool: Pool | None = None) -> DataFrame:
    """Matching items per query with their position; with a pool, only the first of them.

    The order is product, default variant first, variant; without a pool `position`
    is a struct that sorts so, and no query's matches are brought together. Queries
    with the same words and limits are answered once.
    """
    size = F.lit(None).cast("int") if pool is None else F.greatest(F.col("limit") * pool.factor, F.lit(pool.least))
    q = queries.select(
        "query_id",
        F.trim("query").alias("words"),
        F.coalesce("include_out_of_stock", F.lit(False)).alias("with_empty"),
        size.alias("pool"),
    ).withColumn("term", fold("words"))
    terms = q.select("term").distinct()
    slim = items.select("product_id", "combination_id", "physical_quantity", "default_on", *TEXTS, "product_sku", "combination_sku")
    texts = slim.select(
        "product_id", "combination_id", "physical_quantity", "default_on",
        F.explode(F.array_distinct(F.array(*[fold(c) for c in TEXTS]))).alias("text"),
    ).filter(F.col("text").isNotNull())
    hits = text_matches(terms, texts.select("text").distinct())
    skus = slim.select(
        "product_id", "combination_id", "physical_quantity", "default_on",
        F.explode(F.array_distinct(F.array(fold("product_sku"), fold("combination_sku")))).alias("term"),
    ).join(terms, "term", "left_semi")
    matched = hits.join(texts, "text").drop("text").unionByName(skus).distinct()
    key = ["term", "with_empty"] if pool is None else ["term", "with_empty", "pool"]
    contexts = q.select(*key).distinct()
    open_rows = contexts.join(matched, "term").filter(F.col("with_empty") | (F.col("physical_quantity") > 0))
    if pool is None:
        place = F.struct("product_id", F.coalesce(-F.col("default_on"), F.lit(1 << 30)).alias("d"), "combination_id")
        kept = open_rows.select(*key, "product_id", "combination_id", place.alias("position"))
    else:
        order = [F.col("product_id").asc(), F.col("default_on").desc_nulls_last(), F.col("combination_id").asc()]
        most = max(most_wanted(queries) * pool.factor, pool.least)
        kept = top_k_by(open_rows, key, order, F.col("pool"), "position", most).select(*key, "product_id", "combination_id", "position")
    found = q.join(kept, key).drop("with_empty", "pool", "term")
    return found.join(items.drop("default_on"), ["product_id", "combination_id"])


def most_wanted(queries: DataFrame) -> int:
    """The largest limit of a query."""
    return queries.agg(F.coalesce(F.max("limit"), F.lit(0))).first()[0]


def top_k_by(df: DataFrame, partition: list[str], order: list[Column], k: Column, rank: str, most: int) -> DataFrame:
    """First k rows per group where k differs by row and is at most `most`, which is what cuts on the map side."""
    window = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= most).filter(F.col(rank) <= k)


def with_match(candidates: DataFrame) -> DataFrame:
    """Adds sku, match_type and score (lower is better)."""
    term = F.lower("words")
    sku = F.coalesce("combination_sku", "product_sku")
    name = F.lower("product_name")
    short = F.lower(F.coalesce(html_to_text(F.col("short_description")), F.lit("")))
    match_type = (
        F.when(F.lower(sku) == term, "exact_sku")
        .when(name == term, "exact_name")
        .when(F.contains(name, term), "partial_name")
        .otherwise("description")
    )
    base = (
        F.when(F.lower(sku) == term, 0.0)
        .when(name == term, 1.0)
        .when(F.contains(name, term), 2.0)
        .when(F.contains(short, term), 3.0)
        .otherwise(4.0)
    )
    bonus = F.when(F.col("is_default") == 1, 0.5).otherwise(0.0)
    return (
        candidates.withColumn("sku", sku).withColumn("match_type", match_type).withColumn("score", base - bonus)
    )


def search(queries: DataFrame, items: DataFrame, pool: Pool | None = None) -> DataFrame:
    """Ranked items per query, up to the limit of the query; of all matches, or of those in the pool.

    Queries with the same words, limit and stock wish are one question: it is scored and
    cut once, and only the rows that stay meet the queries.
    """
    asked = [F.trim("query").alias("query"), "limit", F.coalesce("include_out_of_stock", F.lit(False)).alias("include_out_of_stock")]
    named = queries.select("query_id", F.struct(*asked).alias("question"))
    questions = named.select("question").distinct().select(F.col("question").alias("query_id"), "question.*")
    scored = with_match(search_candidates(questions, items, pool)).withColumn("limit", F.col("query_id")["limit"])
    # equal scores and names keep the order of retrieval
    order = [F.col("score").asc(), F.col("product_name").asc(), F.col("position").asc()]
    ranked = top_k_by(scored, ["query_id"], order, F.col("limit"), "rank", most_wanted(queries))
    return named.join(ranked.withColumnRenamed("query_id", "question"), "question").drop("question")


def product_texts(requests: DataFrame, cat: Cat.Catalog) -> DataFrame:
    """Product with texts and variants, and chosen variant of each request, with an outcome code.

    `requests`: request_id, product_id, combination_id (0 = choose), quantity
    and the price context. `attributes` are those of the chosen variant, none for a
    base product. `variants` is ordered as in `listed_variants`, empty for a product
    without any. Both and the texts are NULL where the outcome is not ok, and
    `attributes` also where no variant is chosen.
    """
    texts = Cat.product_core(cat, requests).select("product_id", "short_description", "long_description")
    attributes = Cat.variant_attributes(cat, requests).withColumnRenamed("combination_id", "selected")
    listed = listed_variants(cat, requests)
    chosen = (
        choose_variant(requests, cat)
        .join(texts, "product_id", "left")
        .join(listed, "product_id", "left")
        .join(attributes, ["product_id", "selected"], "left")
    )
    ok = F.col("outcome") == "ok"
    return chosen.withColumns(
        {
            "short_description": F.when(ok, F.col("short_description")),
            "long_description": F.when(ok, F.col("long_description")),
            "variants": F.when(ok, F.coalesce("variants", F.array().cast(listed.schema["variants"].dataType))),
            "attributes": F.when(F.col("selected").isNotNull(), F.coalesce("attributes", F.array().cast(ATTRIBUTES))),
        }
    )


def product_detail(requests: DataFrame, cat: Cat.Catalog, rules: DataFrame, as_of: str) -> DataFrame:
    """The rows of `product_texts` with the stock and price of the chosen variant."""
    chosen = product_texts(requests, cat)
    stock = cat.stock.filter(F.col("shop_id") == cat.shop_id).select(
        "product_id",
        F.col("combination_id").alias("selected"),
        F.coalesce("physical_quantity", F.lit(0)).alias("stock_quantity"),
    )
    priceable = chosen.filter(F.col("selected").isNotNull()).select(
        "request_id", "product_id", F.col("selected").alias("combination_id"), "quantity", *Cat.CONTEXT
    )
    quotes = price_quote(priceable, cat, rules, as_of).select("request_id", "unit_price", "subtotal", "specific_price_id")
    return (
        chosen.join(stock, ["product_id", "selected"], "left")
        .join(quotes, "request_id", "left")
        .withColumn(
            "available",
            F.when(F.col("selected").isNotNull(), F.coalesce(F.col("stock_quantity") > 0, F.lit(False))),
        )
    )


def listed_variants(cat: Cat.Catalog, requests: DataFrame) -> DataFrame:
    """(product_id, variants): the variants in stock tables, default first, then by id.

    A variant without a reference has that of its product.
    """
    products = Cat.product_core(cat, requests).select("product_id", F.col("sku").alias("product_sku"))
    defaults = cat.product_attribute.select("combination_id", F.coalesce(-F.col("default_on"), F.lit(1)).alias("place"))
    rows = (
        Cat.variants(cat, requests)
        .join(products, "product_id")
        .join(defaults, "combination_id")
        .join(Cat.variant_attributes(cat, requests), ["product_id", "combination_id"], "left")
        .withColumn("sku", F.coalesce("sku", "product_sku"))
        .withColumn("attributes", F.coalesce("attributes", F.array().cast(ATTRIBUTES)))
    )
    entry = F.struct(*VARIANT)
    ordered = F.sort_array(F.collect_list(F.struct("place", "combination_id", entry.alias("entry"))))
    return rows.groupBy("product_id").agg(F.transform(ordered, lambda v: v["entry"]).alias("variants"))


def choose_variant(requests: DataFrame, cat: Cat.Catalog) -> DataFrame:
    """Outcome code and selected combination per request.

    PRODUCT_NOT_FOUND and COMBINATION_NOT_FOUND are rows, not failures: one bad
    request leaves the others alone.
    """
    core = Cat.product_core(cat, requests).select("product_id", "name", F.col("sku").alias("product_sku"))
    listed = Cat.variants(cat, requests)
    summary = listed.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("variant_count"), F.count_if("available").alias("available_variants")
    )
    default = Cat.default_variant(cat, requests).select("product_id", F.col("combination_id").alias("default_id"))
    found = (
        requests.join(core, "product_id", "left")
        .join(summary, "product_id", "left")
        .join(default, "product_id", "left")
        .withColumn("variant_count", F.coalesce("variant_count", F.lit(0).cast("bigint")))
    )
    wanted = F.when(F.col("combination_id") > 0, F.col("combination_id")).otherwise(
        F.when(F.col("variant_count") > 0, F.col("default_id")).otherwise(F.lit(0).cast("bigint"))
    )
    variant = listed.select(
        "product_id",
        F.col("combination_id").alias("wanted"),
        F.col("sku").alias("variant_sku"),
        F.col("label").alias("variant_label"),
        F.lit(True).alias("__listed"),
    )
    joined = found.withColumn("wanted", wanted).join(variant, ["product_id", "wanted"], "left")
    outcome = (
        F.when(F.col("name").isNull(), "PRODUCT_NOT_FOUND")
        .when((F.col("combination_id") > 0) & F.col("__listed").isNull(), "COMBINATION_NOT_FOUND")
        .otherwise("ok")
    )
    base = (F.col("variant_count") == 0) & (F.col("wanted") == 0)
    joined = joined.withColumn("outcome", outcome)
    ok = F.col("outcome") == "ok"
    selected = F.when(ok & (F.col("__listed") | base), F.col("wanted"))
    return joined.withColumn("selected", selected).select(
        *requests.columns,
        "outcome",
        F.when(ok, F.col("name")).alias("name"),
        F.when(ok, F.col("variant_count")).alias("variant_count"),
        "selected",
        F.when(F.col("selected").isNotNull(), F.coalesce("variant_sku", "product_sku")).alias("sku"),
        F.when(F.col("selected").isNotNull(), F.col("variant_label")).alias("label"),
    )
