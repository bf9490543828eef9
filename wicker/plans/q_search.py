"""Queries over catalogue search, product detail and product intent."""

from __future__ import annotations

from pyspark.sql import functions as F

from wicker.functions import text as T
from wicker.operators import intent as I
from wicker.operators import search as G
from wicker.plans import views as V
from wicker.plans.registry import cte, query
from wicker.session import stage_table


def norm(x: str) -> str:
    out = f"lower(strip_accents(coalesce({x}, '')))"
    for spelled, unit in T.UNITS:
        out = rf"regexp_replace({out}, '(?i)\b(\d+(?:[.,]\d+)?)\s*({spelled})\b', '\1 {unit}', 'g')"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def toks(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[^a-z0-9.,]+'), lambda t: t <> '' AND t NOT IN ({STOP}))"


def units(x: str) -> str:
    found = rf"regexp_extract_all({x}, '\b\d+(?:[.,]\d+)?\s*(?:kg|mm|cm|m)\b')"
    return rf"list_transform({found}, lambda t: regexp_replace(t, '\s+', ' ', 'g'))"


# -- markup and words over whole texts --------------------------------------
HTML = "html"
for pattern, replacement in [
    (r"(?is)<script\b.*?</script>", " "),
    (r"(?is)<style\b.*?</style>", " "),
    (r"<[^>]+>", " "),
    (r"(?i)&nbsp;", " "),
    (r"(?i)&amp;", "&"),
    (r"(?i)&quot;", '"'),
    (r"(?i)&#039;", "''"),
    (r"\s+", " "),
]:
    HTML = f"regexp_replace({HTML}, '{pattern}', '{replacement}', 'g')"


@query("html_to_text", f"SELECT page_id, trim({HTML}) AS text FROM pages")
def _(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


@query(
    "query_normalise",
    f"""
    SELECT doc_id, md5(n) AS normalised, len(w) AS tokens, len(u) AS unit_tokens,
      len(list_distinct(list_concat(list_concat([n], w), u))) AS searchable_terms
    FROM (SELECT doc_id, n, {toks("n")} AS w, {units("n")} AS u FROM
      (SELECT doc_id, {norm("text")} AS n FROM documents))
    """,
)
def _(spark, sf):
    """Query words over whole document texts."""
    found = I.normalise_queries(V.table(spark, sf, "documents").select("doc_id", "text"), "text")
    return found.select(
        "doc_id",
        F.md5("normalised").alias("normalised"),
        *[F.size(c).cast("bigint").alias(c) for c in ("tokens", "unit_tokens", "searchable_terms")],
    )


# -- catalogue search --------------------------------------------------------
cte(
    "search_items",
    """
    SELECT p.product_id, coalesce(v.combination_id, 0) AS combination_id, p.reference AS product_sku,
      v.reference AS combination_sku, p.name AS product_name,
      '<p>' || replace(p.short_description, '&', '&amp;') || '</p>' AS short_description, p.short_description AS plain_short,
      '<div>' || replace(p.long_description, 'Size ', 'Size <b>') || '</b></div>' AS long_description,
      l.label AS variant_label, coalesce(s.physical_quantity, 0) AS physical_quantity,
      v.combination_id IS NOT NULL AS has_variants, coalesce(v.default_on, 0) AS is_default, v.default_on
    FROM cat_product p LEFT JOIN cat_variant v ON v.product_id = p.product_id
    LEFT JOIN cat_stock s ON s.product_id = p.product_id AND s.combination_id = coalesce(v.combination_id, 0)
    LEFT JOIN cat_labels l ON l.combination_id = v.combination_id WHERE p.active
    """,
    "cat_product",
    "cat_stock",
    "cat_labels",
)
cte(
    "search_queries",
    """SELECT p_partkey AS query_id, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN 'ref-' || p_partkey
       ELSE ' ' || p_brand END AS query, CAST(3 + p_partkey % 3 AS INTEGER) AS lim, p_partkey % 2 = 0 AS with_empty FROM part""",
)


def search_ctes(prefix: str, queries: str, items: str, pool: str = "greatest({}lim * 10, 50)") -> None:
    """Brute-force candidates and ranked results; queries: query_id, query, lim, with_empty."""
    fold = lambda c: f"lower(strip_accents({c}))"
    cte(
        f"{prefix}_cand",
        f"""
        SELECT q.query_id, q.lim, lower(trim(q.query)) AS words, i.*, position
        FROM (SELECT term, with_empty, pool, product_id, combination_id, row_number() OVER
                (PARTITION BY term, with_empty, pool ORDER BY product_id, default_on DESC NULLS LAST, combination_id) AS position
              FROM (SELECT DISTINCT {fold("trim(query)")} AS term, with_empty, {pool.format("")} AS pool FROM {queries})
              JOIN {items} ON (with_empty OR physical_quantity > 0) AND ({fold("product_sku")} = term OR {fold("combination_sku")} = term
                OR contains({fold("product_name")}, term) OR contains({fold("short_description")}, term)
                OR contains({fold("long_description")}, term))) c
        JOIN {queries} q ON {fold("trim(q.query)")} = c.term AND q.with_empty = c.with_empty AND {pool.format("q.")} = c.pool
        JOIN {items} i ON i.product_id = c.product_id AND i.combination_id = c.combination_id
        WHERE position <= c.pool
        """,
        queries,
        items,
    )
    cte(
        f"{prefix}_match",
        f"""
        SELECT *, CASE WHEN lower(sku) = words THEN 'exact_sku' WHEN lower(product_name) = words THEN 'exact_name'
            WHEN contains(lower(product_name), words) THEN 'partial_name' ELSE 'description' END AS match_type,
          CASE WHEN lower(sku) = words THEN 0.0::DOUBLE WHEN lower(product_name) = words THEN 1.0
            WHEN contains(lower(product_name), words) THEN 2.0 WHEN contains(lower(plain_short), words) THEN 3.0 ELSE 4.0 END
            - CASE WHEN is_default = 1 THEN 0.5::DOUBLE ELSE 0.0 END AS score
        FROM (SELECT *, coalesce(combination_sku, product_sku) AS sku FROM {prefix}_cand)
        """,
        f"{prefix}_cand",
    )
    cte(
        f"{prefix}_rank",
        f"""
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, product_name, position) AS rank
          FROM {prefix}_match) WHERE rank <= lim
        """,
        f"{prefix}_match",
    )


search_ctes("g", "search_queries", "search_items")


@query(
    "search_candidates",
    """SELECT query_id, product_id, combination_id, product_sku, combination_sku, product_name, variant_label,
       physical_quantity, has_variants, is_default, CAST(position AS INTEGER) AS position FROM g_cand""",
    "g_cand",
)
def _(spark, sf):
    found = G.search_candidates(V.search_queries(spark, sf), G.search_items(V.catalog(spark, sf)), G.SHOP_POOL)
    return found.select(
        "query_id", "product_id", "combination_id", "product_sku", "combination_sku", "product_name", "variant_label",
        "physical_quantity", "has_variants", "is_default", "position",
    )


@query("search_match", "SELECT query_id, product_id, combination_id, sku, match_type, score FROM g_match", "g_match")
def _(spark, sf):
    found = G.with_match(G.search_candidates(V.search_queries(spark, sf), G.search_items(V.catalog(spark, sf)), G.SHOP_POOL))
    return found.select("query_id", "product_id", "combination_id", "sku", "match_type", "score")


@query(
    "search_topk",
    "SELECT query_id, CAST(rank AS INTEGER) AS rank, product_id, combination_id, match_type, score FROM g_rank",
    "g_rank",
)
def _(spark, sf):
    found = G.search(V.search_queries(spark, sf), G.search_items(V.catalog(spark, sf)), G.SHOP_POOL)
    return found.select("query_id", "rank", "product_id", "combination_id", "match_type", "score")


search_ctes("gw", "search_queries", "search_items", "1000000000")


@query(
    "search_topk_whole",
    "SELECT query_id, CAST(rank AS INTEGER) AS rank, product_id, combination_id, match_type, score FROM gw_rank",
    "gw_rank",
)
def _(spark, sf):
    """The best of all matches, not only of those in the shop's pool."""
    found = G.search(V.search_queries(spark, sf), G.search_items(V.catalog(spark, sf)))
    return found.select("query_id", "rank", "product_id", "combination_id", "match_type", "score")


cte(
    "chosen",
    """
    SELECT request_id, product_id, combination_id, quantity, outcome, CASE WHEN outcome = 'ok' THEN name END AS name,
      CASE WHEN outcome = 'ok' THEN variant_count END AS variant_count, selected,
      CASE WHEN selected IS NOT NULL THEN coalesce(variant_sku, product_sku) END AS sku,
      CASE WHEN selected IS NOT NULL THEN variant_label END AS label
    FROM (SELECT *, CASE WHEN outcome = 'ok' AND (listed OR variant_count = 0 AND wanted = 0) THEN wanted END AS selected
      FROM (SELECT w.*, v.combination_id IS NOT NULL AS listed, v.sku AS variant_sku, v.label AS variant_label,
          CASE WHEN w.name IS NULL THEN 'PRODUCT_NOT_FOUND' WHEN w.combination_id > 0 AND v.combination_id IS NULL
            THEN 'COMBINATION_NOT_FOUND' ELSE 'ok' END AS outcome
        FROM (SELECT q.*, p.name, p.reference AS product_sku, coalesce(n.c, 0) AS variant_count,
            CASE WHEN q.combination_id > 0 THEN q.combination_id WHEN coalesce(n.c, 0) > 0 THEN d.id ELSE 0 END AS wanted
          FROM cat_requests q LEFT JOIN cat_product p ON p.product_id = q.product_id AND p.active
          LEFT JOIN (SELECT product_id, count(*) AS c FROM variant_rows GROUP BY 1) n ON n.product_id = q.product_id
          LEFT JOIN (SELECT product_id, min(combination_id) AS id FROM cat_variant WHERE default_on = 1 GROUP BY 1) d
            ON d.product_id = q.product_id) w
        LEFT JOIN variant_rows v ON v.product_id = w.product_id AND v.combination_id = w.wanted))
    """,
    "cat_requests",
    "variant_rows",
)


@query(
    "product_batch",
    """SELECT request_id, outcome, name, CAST(variant_count AS BIGINT) AS variant_count, selected, sku, label FROM chosen""",
    "chosen",
)
def _(spark, sf):
    found = G.choose_variant(V.catalog_requests(spark, sf), V.catalog(spark, sf))
    return found.select("request_id", "outcome", "name", "variant_count", "selected", "sku", "label")


@query(
    "product_detail",
    """SELECT c.request_id, outcome, selected, sku, coalesce(s.physical_quantity, CASE WHEN s.product_id IS NOT NULL THEN 0 END)
         AS stock_quantity, CASE WHEN selected IS NOT NULL THEN coalesce(s.physical_quantity > 0, false) END AS available
       FROM chosen c LEFT JOIN cat_stock s ON s.product_id = c.product_id AND s.combination_id = c.selected""",
    "chosen",
    "cat_stock",
)
def _(spark, sf):
    found = G.product_detail(
        V.catalog_requests(spark, sf), V.catalog(spark, sf), V.price_rules(spark, sf), V.AS_OF
    )
    return found.select("request_id", "outcome", "selected", "sku", "stock_quantity", "available")


cte(
    "attribute_texts",
    """
    SELECT combination_id, string_agg("group" || '=' || value, ';' ORDER BY "group", value) AS attributes
    FROM cat_attributes GROUP BY 1
    """,
    "cat_attributes",
)
cte(
    "variant_texts",
    """
    SELECT product_id, string_agg(concat_ws('|', combination_id, coalesce(r.sku, p.reference, '~'), coalesce(label, '~'),
        coalesce(attributes, ''), CAST(CAST(r.impact_net AS DECIMAL(20, 6)) AS VARCHAR), coalesce(physical_quantity, 0),
        coalesce(physical_quantity, 0) > 0, is_default), chr(10) ORDER BY v.default_on DESC NULLS LAST, combination_id) AS variants
    FROM variant_rows r JOIN cat_product p USING (product_id) JOIN cat_variant v USING (product_id, combination_id)
    LEFT JOIN attribute_texts USING (combination_id) GROUP BY product_id
    """,
    "variant_rows",
    "attribute_texts",
)


def attribute_text(c):
    return F.array_join(F.transform(c, lambda a: F.concat_ws("=", a["group"], a["value"])), ";")


def variant_text(v):
    plain = ["impact_net", "physical_quantity", "available", "is_default"]
    return F.concat_ws(
        "|", v["combination_id"], F.coalesce(v["sku"], F.lit("~")), F.coalesce(v["label"], F.lit("~")),
        attribute_text(v["attributes"]), *[v[c].cast("string") for c in plain],
    )


@query(
    "product_detail_full",
    """SELECT c.request_id, outcome, c.name, CASE WHEN outcome = 'ok' THEN short_description END AS short_description,
         CASE WHEN outcome = 'ok' THEN long_description END AS long_description, selected, sku, label,
         CASE WHEN selected IS NOT NULL THEN coalesce(attributes, '') END AS attributes,
         CASE WHEN outcome = 'ok' THEN coalesce(variants, '') END AS variants
       FROM chosen c LEFT JOIN cat_product p ON p.product_id = c.product_id AND p.active
       LEFT JOIN variant_texts t ON t.product_id = c.product_id
       LEFT JOIN attribute_texts a ON a.combination_id = c.selected""",
    "chosen",
    "variant_texts",
)
def _(spark, sf):
    """Detail rows with the product's texts and variants, lists as text."""
    found = G.product_texts(V.catalog_requests(spark, sf), V.catalog(spark, sf))
    return found.select(
        "request_id", "outcome", "name", "short_description", "long_description", "selected", "sku", "label",
        attribute_text("attributes").alias("attributes"),
        F.array_join(F.transform("variants", variant_text), "\n").alias("variants"),
    )


@query("product_detail_priced")
def _(spark, sf):
    """Detail rows with the price of the chosen variant."""
    found = G.product_detail(
        V.catalog_requests(spark, sf), V.catalog(spark, sf), V.price_rules(spark, sf), V.AS_OF
    )
    return found.select("request_id", "outcome", "selected", "unit_price", "subtotal", "specific_price_id")


# -- intent ------------------------------------------------------------------
NAME = """CASE p_partkey % 6 WHEN 0 THEN 'Barra Olímpica ' || p_size || ' kg' WHEN 1 THEN 'Disco Bumper ' || p_size || ' kg'
  WHEN 2 THEN 'Kettlebell ' || p_size || ' kg' WHEN 3 THEN 'Barra Z ' || p_name
  WHEN 4 THEN 'Colchoneta ' || p_size || ' cm' ELSE p_name || ' ' || p_size || ' mm' END"""
cte(
    "iq",
    """
    SELECT p_partkey AS query_id, CASE p_partkey % 8 WHEN 0 THEN ' Barra  Olímpica ' || p_size || ' kilos'
        WHEN 1 THEN 'disco bumper ' || p_size || 'kg' WHEN 2 THEN 'Pesa rusa ' || p_size || ' KG' WHEN 3 THEN p_name
        WHEN 4 THEN 'ref' || p_partkey WHEN 5 THEN 'barra' WHEN 6 THEN 'Kettlebell'
        ELSE 'colchoneta ' || p_size || ',0 centímetros' END AS query,
      CASE WHEN p_partkey % 3 = 0 THEN 'para gimnasio standard' END AS intended_use,
      CASE WHEN p_partkey % 4 = 0 THEN p_type END AS category_wanted, CASE WHEN p_partkey % 5 = 0 THEN p_brand END AS preferred,
      CASE WHEN p_partkey % 6 = 0 THEN p_partkey END AS excluded, p_partkey % 9 = 0 AS in_stock_only,
      CASE WHEN p_partkey % 2 = 0 THEN 10 ELSE 5 END AS lim
    FROM part
    """,
)
SYNONYM_SQL = "list_distinct([]::VARCHAR[])"
for phrases, terms in reversed(I.SYNONYMS):
    hit = " OR ".join(f"n = '{p}'" if p == I.BROAD else f"contains(n, '{p}')" for p in phrases)
    SYNONYM_SQL = f"list_concat(CASE WHEN {hit} THEN {terms!r} ELSE [] END, {SYNONYM_SQL})"


def type_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '{p}') THEN '{n}'" for n, p in I.PRODUCT_TYPES) + " END"


def measure_sql(x: str, kind: str) -> tuple[str, str]:
    """SQL of value and unit."""
    raw = lambda w: rf"regexp_extract({x}, '\b(\d+(?:[.,]\d+)?)\s*(?:{w})\b', 1)"
    values = " ".join(
        f"WHEN {raw(w)} <> '' THEN round(CAST(replace({raw(w)}, ',', '.') AS DOUBLE) * {f}::DOUBLE, 6)"
        for w, f, _ in I.MEASURES[kind]
    )
    names = " ".join(f"WHEN {raw(w)} <> '' THEN '{u}'" for w, _, u in I.MEASURES[kind])
    return f"CASE {values} END", f"CASE {names} END"


QUERY_MEASURES = ", ".join(
    f"{measure_sql('txt', k)[0]} AS c_{k}, {measure_sql('txt', k)[1]} AS u_{k}" for k in I.MEASURES
)
UNDERSTOOD_SQL = f"""
    SELECT *, CAST(c_product_type IS NOT NULL AS INTEGER) + CAST(c_weight IS NOT NULL AS INTEGER)
        + CAST(c_diameter IS NOT NULL AS INTEGER) + CAST(c_length IS NOT NULL AS INTEGER)
        + CAST(c_reference IS NOT NULL AS INTEGER) AS constraint_count
    FROM (SELECT *, {type_sql("txt")} AS c_product_type, {QUERY_MEASURES},
        CASE WHEN len(tokens) = 1 AND regexp_matches(tokens[1], '[a-z]+[-_]*\\d+|\\d+[-_]*[a-z]+') THEN tokens[1] END AS c_reference
      FROM (SELECT *, CASE WHEN len(synonyms) = 1 THEN n || ' ' || synonyms[1] ELSE n END AS txt
        FROM (SELECT *, {toks("n")} AS tokens, {units("n")} AS unit_tokens,
            list_filter({SYNONYM_SQL}, lambda x, i: list_position({SYNONYM_SQL}, x) = i) AS synonyms
          FROM (SELECT *, {norm("trim(query)")} AS n FROM <queries>))))
    """
cte("iu", UNDERSTOOD_SQL.replace("<queries>", "iq"), "iq")


def understood(spark, sf):
    return I.understand(V.intent_queries(spark, sf))


@query(
    "query_synonyms",
    "SELECT query_id, n AS normalised, array_to_string(synonyms, ',') AS synonym_terms FROM iu",
    "iu",
)
def _(spark, sf):
    return understood(spark, sf).select(
        "query_id", "normalised", F.array_join("synonym_terms", ",").alias("synonym_terms")
    )


@query(
    "query_constraints",
    """SELECT query_id, c_product_type AS product_type, c_weight AS weight, c_diameter AS diameter, u_diameter AS diameter_unit,
       c_length AS length, c_reference AS reference, constraint_count FROM iu""",
    "iu",
)
def _(spark, sf):
    return understood(spark, sf).select(
        "query_id",
        F.col("c_product_type").alias("product_type"),
        F.col("c_weight.value").alias("weight"),
        F.col("c_diameter.value").alias("diameter"),
        F.col("c_diameter.unit").alias("diameter_unit"),
        F.col("c_length.value").alias("length"),
        F.col("c_reference").alias("reference"),
        "constraint_count",
    )


cte(
    "intent_items",
    f"""
    SELECT p_partkey AS product_id, 0 AS combination_id, 'ref' || p_partkey AS product_sku, CAST(NULL AS VARCHAR) AS combination_sku,
      {NAME} AS product_name, '<p>' || p_type || ' ' || p_brand || '</p>' AS short_description,
      p_type || ' ' || p_brand AS plain_short, CAST(NULL AS VARCHAR) AS long_description, p_partkey % 7 - 1 AS physical_quantity,
      0 AS is_default, CAST(NULL AS INTEGER) AS default_on FROM part
    """,
)
COMPACT = r"regexp_replace(t, '\b(\d+(?:[.,]\d+)?)\s+(kg|mm|cm|m)\b', '\1\2', 'g')"
cte(
    "i_terms",
    f"""
    SELECT *, greatest(5, CAST(ceil(pool / greatest(len(terms), 1)::DOUBLE) AS INTEGER)) AS per_term
    FROM (SELECT *, list_slice(list_filter(everything, lambda x, i: list_position(everything, x) = i AND length(trim(x)) >= 2), 1, 8) AS terms
      FROM (SELECT *, list_concat(base, list_transform(base, lambda t: {COMPACT})) AS everything
        FROM (SELECT *, CASE WHEN n = 'barra' AND len(synonyms) > 0 THEN synonyms ELSE list_concat([n], synonyms) END AS base,
            least(50, greatest(lim * 4, 20)) AS pool FROM iu)))
    """,
    "iu",
)
cte(
    "i_searches",
    """SELECT row_number() OVER () AS query_id, * FROM (SELECT DISTINCT term AS query, CAST(pool AS INTEGER) AS lim, with_empty FROM
       (SELECT unnest(terms) AS term, pool, NOT in_stock_only AS with_empty FROM i_terms))""",
    "i_terms",
)
search_ctes("is", "i_searches", "intent_items")
cte(
    "i_lists",
    f"""
    SELECT t.query_id, t.place, max(t.per_term) AS per_term, max(t.pool) AS pool,
      list(r.product_id ORDER BY r.rank) FILTER (n <> 'barra' OR contains({norm("r.product_name")}, t.term)) AS found
    FROM (SELECT query_id, n, unnest(terms) AS term, generate_subscripts(terms, 1) AS place, pool, per_term,
        NOT in_stock_only AS with_empty FROM i_terms) t
    JOIN i_searches s ON s.query = t.term AND s.lim = t.pool AND s.with_empty = t.with_empty
    JOIN is_rank r ON r.query_id = s.query_id GROUP BY ALL
    """,
    "is_rank",
    "i_terms",
)
cte(
    "i_fold",
    """
    SELECT query_id, 0 AS step, []::BIGINT[] AS acc FROM i_terms
    UNION ALL
    SELECT f.query_id, f.step + 1, list_concat(f.acc, list_slice(list_filter(coalesce(l.found, []), lambda x: NOT list_contains(f.acc, x)),
      1, coalesce(l.per_term, 1)))
    FROM i_fold f LEFT JOIN i_lists l ON l.query_id = f.query_id AND l.place = f.step + 1 WHERE f.step < 8
    """,
    "i_lists",
)
cte(
    "i_hits",
    """SELECT query_id, unnest(list_slice(acc, 1, pool)) AS product_id FROM i_fold JOIN i_terms USING (query_id) WHERE step = 8""",
    "i_fold",
)


def hits(spark, sf):
    return I.intent_hits(stage_table(understood(spark, sf), "understood"), V.intent_items(spark, sf))


@query("intent_hits", "SELECT query_id, product_id FROM i_hits", "i_hits")
def _(spark, sf):
    return hits(spark, sf).select("query_id", "product_id")


P_MEASURES = ", ".join(
    f"coalesce({', '.join(measure_sql(c, k)[0] for c in ('n_attributes', 'n_identity', 'n_all'))}) AS p_{k}, "
    f"coalesce({', '.join(measure_sql(c, k)[1] for c in ('n_attributes', 'n_identity', 'n_all'))}) AS q_{k}"
    for k in I.MEASURES
)
cte(
    "i_products",
    f"""
    SELECT *, {type_sql("n_all")} AS p_product_type, {P_MEASURES}
    FROM (SELECT *, {norm("reference || ' ' || name")} AS n_identity,
        {norm("concat_ws(' ', nullif(n_attributes, ''), reference, name, category, description)")} AS n_all,
        n_name || ' ' || n_reference || ' ' || n_category || ' ' || n_description || ' ' || n_attributes AS n_product,
        {norm("concat_ws(' ', name, category, description, attributes)")} AS n_facet
      FROM (SELECT *, {norm("name")} AS n_name, {norm("reference")} AS n_reference, {norm("category")} AS n_category,
          {norm("description")} AS n_description, {norm("attributes")} AS n_attributes
        FROM (SELECT p_partkey AS product_id, {NAME} AS name, 'ref' || p_partkey AS reference, p_type || ' ' || p_brand AS description,
            CASE WHEN p_type <> 'ECONOMY' THEN 'Cat ' || p_type END AS category, p_partkey % 17 <> 0 AS active,
            CASE WHEN p_partkey % 37 <> 0 THEN p_retailprice END AS price,
            CASE WHEN p_partkey % 31 = 0 THEN 'unknown' WHEN p_partkey % 7 > 1 THEN 'in_stock' ELSE 'out_of_stock' END AS stock_status,
            CASE WHEN p_partkey % 5 = 0 THEN 'Peso ' || p_size || ' kg' END AS attributes FROM part)))
    """,
)
cte(
    "i_eligible",
    """
    SELECT u.*, p.* FROM i_hits h JOIN iu u ON u.query_id = h.query_id JOIN i_products p ON p.product_id = h.product_id
    WHERE p.active AND (u.excluded IS NULL OR u.excluded <> p.product_id) AND (NOT in_stock_only OR stock_status = 'in_stock')
    """,
    "i_hits",
    "i_products",
)


def eligible(spark, sf):
    """Understood wishes, their hits and eligible products, and the queries behind each wish."""
    asked, links = I.wishes(V.intent_queries(spark, sf))
    links = stage_table(links, "links")
    words = stage_table(I.understand(asked), "understood")
    found = stage_table(I.intent_hits(words, V.intent_items(spark, sf)), "hits")
    rows = I.eligible(found, words, I.describe_products(V.intent_products(spark, sf)))
    return words, found, rows, links


@query("intent_eligible", "SELECT query_id, product_id FROM i_eligible", "i_eligible")
def _(spark, sf):
    _, _, rows, links = eligible(spark, sf)
    return I.of_queries(rows.select("query_id", "product_id"), links)


def state(kind: str) -> str:
    if kind == "product_type":
        return """CASE WHEN c_product_type IS NOT NULL THEN CASE WHEN p_product_type IS NULL THEN 'not_available'
          WHEN p_product_type = c_product_type THEN 'matched' ELSE 'contradicted' END END"""
    return f"""CASE WHEN c_{kind} IS NOT NULL THEN CASE WHEN p_{kind} IS NULL OR u_{kind} <> q_{kind} THEN 'not_available'
      WHEN abs(c_{kind} - p_{kind}) < 0.001 THEN 'matched' ELSE 'contradicted' END END"""


def states_cte(name: str, eligible: str, kinds: list[str]) -> None:
    """States of the constraints of a query for each product that is eligible."""
    tally = lambda s: " + ".join(f"CAST(coalesce(m_{k} = '{s}', false) AS INTEGER)" for k in kinds)
    named = "".join(
        f", CASE WHEN c_{k} IS NOT NULL THEN CASE WHEN contains(n_all, c_{k}) THEN 'matched' ELSE 'contradicted' END END AS m_{k}" for k in I.NAMED if k in kinds
    )
    cte(
        name,
        f"""
        SELECT *, {tally("matched")} AS matched, {tally("contradicted")} AS contradicted,
          constraint_count > 0 AND {tally("matched")} = constraint_count AS satisfies_all
        FROM (SELECT *, {", ".join(f"{state(k)} AS m_{k}" for k in ("product_type", "weight", "diameter", "length"))},
            CASE WHEN c_reference IS NOT NULL THEN CASE WHEN contains(n_identity, c_reference) THEN 'matched' ELSE 'contradicted' END END
              AS m_reference{named} FROM {eligible})
        """,
        eligible,
    )


states_cte("i_states", "i_eligible", I.CONSTRAINTS)


@query(
    "intent_constraints",
    f"SELECT query_id, product_id, {', '.join(f'm_{k}' for k in I.CONSTRAINTS)}, satisfies_all FROM i_states",
    "i_states",
)
def _(spark, sf):
    _, _, rows, links = eligible(spark, sf)
    states = I.evaluate_constraints(rows).select("query_id", "product_id", *[f"m_{k}" for k in I.CONSTRAINTS], "satisfies_all")
    return I.of_queries(states, links)


def cover(words: str, x: str) -> str:
    return f"""CASE WHEN len({words}) > 0 THEN len(list_filter({words}, lambda w: contains({x}, w)))::DOUBLE / len({words})
      ELSE 0.0::DOUBLE END"""


bonus_sql = lambda values: " + ".join(f"CASE WHEN m_{k} = 'matched' THEN {v}::DOUBLE ELSE 0.0::DOUBLE END" for k, v in values.items())
CLAMP = lambda x: f"round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x})), 6)"
def scored_cte(name: str, states: str, values: dict[str, float]) -> None:
    """Scores of eligible products from their states."""
    cte(
        name,
        f"""
    SELECT *, CASE WHEN contradicted > 0 THEN false WHEN same_reference THEN true WHEN constraint_count = 0 THEN score > 0
        ELSE score >= 0.35 END AS plausible
    FROM (SELECT *, CASE WHEN same_reference THEN 1.0::DOUBLE WHEN same_name THEN {CLAMP("0.95::DOUBLE * penalty")}
        ELSE {CLAMP("greatest(base + bonus, CASE WHEN satisfies_all AND constraint_count >= 2 THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END) * penalty")} END AS score
      FROM (SELECT *, 0.7::DOUBLE * name_cover + 0.12::DOUBLE * attribute_cover + 0.08::DOUBLE * category_cover
          + CASE WHEN synonym_hit THEN 0.06::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN use_hit THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END
          + 0.04::DOUBLE * description_cover AS base, {bonus_sql(values)} AS bonus,
          CASE WHEN contradicted = 0 THEN 1.0::DOUBLE ELSE greatest(0.08::DOUBLE, 0.22::DOUBLE / contradicted) END AS penalty,
          n_reference = n AS same_reference, n_name = n AS same_name
        FROM (SELECT *, {cover("tokens", "n_name")} AS name_cover,
            greatest({cover("tokens", "n_category")}, CASE WHEN contains(n_category, {norm("category_wanted")}) AND category_wanted IS NOT NULL
              THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS category_cover,
            {cover("tokens", "n_description")} AS description_cover,
            greatest({cover("unit_tokens", "n_attributes")}, {cover("unit_tokens", "n_product")},
              CASE WHEN contains(n_product, {norm("preferred")}) AND preferred IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS attribute_cover,
            len(list_filter(synonyms, lambda t: contains(n_product, t))) > 0 AS synonym_hit,
            intended_use IS NOT NULL AND contains(n_product, 'gimnasio') AND contains(n_product, 'standard') AS use_hit
          FROM {states})))
    """,
        states,
    )


scored_cte("i_scored", "i_states", I.BONUS)


def scored(spark, sf):
    words, found, rows, links = eligible(spark, sf)
    return words, found, I.score(I.evaluate_constraints(rows)), links


@query("intent_score", "SELECT query_id, product_id, score, plausible FROM i_scored", "i_scored")
def _(spark, sf):
    _, _, rows, links = scored(spark, sf)
    return I.of_queries(rows.select("query_id", "product_id", "score", "plausible"), links)


cte(
    "i_ranked",
    """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY plausible DESC, score DESC, name,
         CAST(product_id AS VARCHAR)) AS rank FROM i_scored WHERE score > 0""",
    "i_scored",
)


def ranked(spark, sf, *columns):
    """Queries with the columns of their wish that a decision reads, hits of a wish, ranked products of each query, links."""
    words, found, rows, links = scored(spark, sf)
    best = stage_table(I.rank(rows).select("query_id", "rank", "product_id", "combination_id", *columns), "ranked")
    wished = words.select(F.col("query_id").alias("wish"), "query", "normalised", "limit", "constraint_count")
    return links.join(wished.hint("merge"), "wish"), found, I.of_queries(best, links, "rank"), links


DECIDED = ["score", "plausible", "satisfies_all"]


@query("intent_topk", "SELECT query_id, product_id, CAST(rank AS INTEGER) AS rank, score FROM i_ranked", "i_ranked")
def _(spark, sf):
    return ranked(spark, sf, "score")[2].select("query_id", "product_id", "rank", "score")


cte(
    "i_decided",
    """
    SELECT query_id, CASE WHEN top IS NULL THEN 'no_match' WHEN by_constraints OR by_score THEN 'resolved'
        ELSE 'clarification_required' END AS status,
      CASE WHEN top IS NULL THEN 0.0::DOUBLE WHEN by_constraints THEN full_score ELSE top END AS confidence,
      CASE WHEN by_constraints THEN full_id WHEN by_score THEN top_id END AS resolved_product_id
    FROM (SELECT *, coalesce(constraint_count > 0 AND fulls = 1 AND full_score >= 0.82, false) AS by_constraints,
        coalesce(constraint_count = 0 AND top >= 0.82 AND (second IS NULL OR top - second >= 0.12::DOUBLE), false) AS by_score
      FROM iu LEFT JOIN (SELECT query_id, max(score) FILTER (place = 1) AS top, max(product_id) FILTER (place = 1) AS top_id,
          max(score) FILTER (place = 2) AS second, count(*) FILTER (satisfies_all) AS fulls,
          max(score) FILTER (satisfies_all) AS full_score, max(product_id) FILTER (satisfies_all) AS full_id
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM i_ranked
              WHERE plausible AND score >= 0.4) GROUP BY query_id) USING (query_id))
    """,
    "i_ranked",
)


@query("intent_decision", "SELECT query_id, status, confidence, resolved_product_id FROM i_decided", "i_decided")
def _(spark, sf):
    words, _, rows, _ = ranked(spark, sf, *DECIDED)
    return I.decide(words, rows).select("query_id", "status", "confidence", "resolved_product_id")


FACET_SQL = "CASE " + " ".join(
    "WHEN " + " AND ".join(f"contains(n_facet, '{w}')" for w in words) + f" THEN '{name}'" for words, name in I.FACET_TYPES
) + " END"
unit_facet = lambda u: rf"nullif(regexp_extract(n_facet, '\b\d+(?:[.,]\d+)? (?:{u})\b'), '')"
cte(
    "i_best",
    """SELECT * FROM (SELECT r.*, row_number() OVER (PARTITION BY r.query_id ORDER BY rank) AS place FROM i_ranked r
       JOIN i_decided d ON d.query_id = r.query_id WHERE plausible AND d.status = 'clarification_required') WHERE place <= 5""",
    "i_ranked",
    "i_decided",
)
cte(
    "i_values",
    f"""
    SELECT query_id, ord, dimension, label, min(place) AS first, string_agg(DISTINCT CAST(product_id AS VARCHAR), ','
        ORDER BY CAST(product_id AS VARCHAR)) AS product_ids
    FROM (SELECT query_id, place, product_id, 0 AS ord, 'product_type' AS dimension, CASE WHEN c_product_type IS NULL THEN {FACET_SQL} END AS label FROM i_best
      UNION ALL SELECT query_id, place, product_id, 1, 'weight', CASE WHEN c_weight IS NULL THEN {unit_facet("kg")} END FROM i_best
      UNION ALL SELECT query_id, place, product_id, 2, 'diameter', CASE WHEN c_diameter IS NULL THEN {unit_facet("mm")} END FROM i_best
      UNION ALL SELECT query_id, place, product_id, 3, 'length', CASE WHEN c_length IS NULL THEN {unit_facet("cm|m")} END FROM i_best
      UNION ALL SELECT query_id, place, product_id, 4, 'category', category FROM i_best)
    WHERE label IS NOT NULL GROUP BY ALL
    """,
    "i_best",
)
cte(
    "i_chosen",
    """SELECT query_id, min(ord) AS ord FROM (SELECT query_id, ord FROM i_values GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1""",
    "i_values",
)


@query(
    "intent_clarify",
    """
    SELECT query_id, dimension, CAST(row_number() OVER (PARTITION BY query_id ORDER BY first, label) AS INTEGER) AS position,
      replace(label, ' ', '_') AS value, label, product_ids FROM i_values JOIN i_chosen USING (query_id, ord)
    UNION ALL SELECT query_id, 'unspecified', CAST(place AS INTEGER), CAST(product_id AS VARCHAR), name, CAST(product_id AS VARCHAR)
    FROM i_best WHERE query_id NOT IN (SELECT query_id FROM i_chosen)
    """,
    "i_chosen",
)
def _(spark, sf):
    asked = [f"c_{k}" for k in ("product_type", *I.MEASURES)]
    words, _, rows, _ = ranked(spark, sf, *DECIDED, "name", "category", "n_facet", *asked)
    return I.clarify(rows, I.decide(words, rows))


@query(
    "intent_stats",
    """
    SELECT query_id, status, coalesce(retrieved, 0) AS retrieved, coalesce(eligible, 0) AS eligible,
      CASE WHEN status = 'no_match' THEN 0 ELSE least(coalesce(eligible, 0), lim) END AS returned,
      array_to_string(list_filter([CASE WHEN n <> query THEN 'QUERY_NORMALIZED' END,
        CASE WHEN status <> 'no_match' AND eligible > lim THEN 'RESULTS_TRUNCATED' END,
        CASE WHEN status <> 'no_match' AND no_price > 0 THEN 'CATALOG_PRICE_UNAVAILABLE' END,
        CASE WHEN status <> 'no_match' AND no_stock > 0 THEN 'CATALOG_STOCK_UNKNOWN' END], lambda x: x IS NOT NULL), ',') AS warnings
    FROM iu JOIN i_decided USING (query_id)
    LEFT JOIN (SELECT query_id, count(*) AS retrieved FROM i_hits GROUP BY 1) USING (query_id)
    LEFT JOIN (SELECT query_id, count(*) AS eligible, count(*) FILTER (place <= lim AND price IS NULL) AS no_price,
        count(*) FILTER (place <= lim AND stock_status = 'unknown') AS no_stock
      FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM i_ranked
            WHERE plausible OR constraint_count = 0) GROUP BY query_id) USING (query_id)
    """,
    "i_decided",
)
def _(spark, sf):
    words, found, rows, links = ranked(spark, sf, *DECIDED, "constraint_count", "limit", "price", "stock_status")
    hits = I.of_queries(found.select("query_id", "product_id"), links.withColumn("excluded", F.lit(None).cast("array<string>")))
    return I.stats(words, hits, rows, I.decide(words, rows)).withColumn("warnings", F.array_join("warnings", ","))


# -- brands and variants -----------------------------------------------------

cte(
    "named_queries",
    """SELECT p_partkey AS query_id, CASE p_partkey % 6 WHEN 0 THEN 'Disco  Bumper ' || p_brand || ' ' || p_size || ' KG'
         WHEN 1 THEN p_brand || ' ' || p_name WHEN 2 THEN 'peso ' || p_size || ' kg de ' || p_brand || ', no de ' || p_name
         WHEN 3 THEN p_name || ' de ' || (p_size + 1) || ' kg' WHEN 4 THEN p_name ELSE 'ref' || p_partkey || ' ' || p_brand END AS query,
       CAST(NULL AS VARCHAR) AS intended_use, CAST(NULL AS VARCHAR) AS category_wanted, CAST(NULL AS VARCHAR) AS preferred FROM part""",
)
cte(
    "phrases",
    f"""SELECT DISTINCT kind, phrase, len(string_split(phrase, ' ')) AS words FROM (
          SELECT 'brand' AS kind, {norm("p_brand")} AS phrase FROM part UNION ALL SELECT 'brand', {norm("p_name || ' de luxe'")} FROM part WHERE p_partkey % 7 = 0
          UNION ALL SELECT 'variant', {norm("'Peso ' || p_size || ' kg'")} FROM part WHERE p_partkey % 5 = 0
          UNION ALL SELECT 'variant', {norm("p_size || ' kg'")} FROM part WHERE p_partkey % 5 = 0)""",
)
cte("nu", UNDERSTOOD_SQL.replace("<queries>", "named_queries"), "named_queries")
cte(
    "n_found",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY words DESC, start, phrase) AS place FROM (
         SELECT query_id, kind, phrase, words, len(string_split(left(padded, strpos(padded, ' ' || phrase || ' ')), ' ')) - 2 AS start
         FROM (SELECT query_id, ' ' || array_to_string(list_transform(string_split(n, ' '), lambda w: regexp_replace(w, '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g')), ' ') || ' ' AS padded FROM nu)
         JOIN phrases ON contains(padded, ' ' || phrase || ' '))) WHERE place = 1""",
    "nu",
    "phrases",
)
cte(
    "n_understood",
    """SELECT * REPLACE (constraint_count + CAST(c_brand IS NOT NULL AS INTEGER) + CAST(c_variant IS NOT NULL AS INTEGER) AS constraint_count) FROM nu
       LEFT JOIN (SELECT query_id, max(phrase) FILTER (kind = 'brand') AS c_brand, max(phrase) FILTER (kind = 'variant') AS c_variant FROM n_found GROUP BY 1) USING (query_id)""",
    "n_found",
)
cte(
    "n_eligible",
    "SELECT u.*, p.* FROM n_understood u JOIN i_products p ON p.product_id BETWEEN u.query_id AND u.query_id + 2",
    "n_understood",
    "i_products",
)
SEVEN = [*I.CONSTRAINTS, *I.NAMED]
states_cte("n_states", "n_eligible", SEVEN)
scored_cte("n_scored", "n_states", I.BONUS | {k: I.NAMED_BONUS for k in I.NAMED})


def named(spark, sf):
    """Queries that name brands and variants, understood."""
    words = I.understand(V.named_queries(spark, sf))
    return I.named_constraints(words, stage_table(I.phrase_dictionary(V.phrases(spark, sf)), "phrases"))


@query("query_phrases", "SELECT query_id, kind, phrase, CAST(start AS INTEGER) AS start, CAST(words AS INTEGER) AS words FROM n_found", "n_found")
def _(spark, sf):
    """The longest brand and variant named by each query."""
    words = I.understand(V.named_queries(spark, sf))
    found = I.find_phrases(words, stage_table(I.phrase_dictionary(V.phrases(spark, sf)), "phrases"))
    return words.select("query_id", "normalised").join(found, "normalised").select("query_id", "kind", "phrase", "start", "words")


def named_rows(spark, sf):
    """Each query with three products."""
    near = F.explode(F.sequence(F.col("query_id"), F.col("query_id") + 2))
    asked = named(spark, sf).withColumn("product_id", near)
    return I.evaluate_constraints(asked.join(I.describe_products(V.intent_products(spark, sf)), "product_id"))


@query(
    "intent_named_constraints",
    f"SELECT query_id, product_id, constraint_count, {', '.join(f'm_{k}' for k in SEVEN)}, satisfies_all FROM n_states",
    "n_states",
)
def _(spark, sf):
    """All seven kinds of constraint, brands and variants among them."""
    return named_rows(spark, sf).select("query_id", "product_id", "constraint_count", *[f"m_{k}" for k in SEVEN], "satisfies_all")


@query("intent_named_score", "SELECT query_id, product_id, score, plausible FROM n_scored", "n_scored")
def _(spark, sf):
    """Scores with the bonus of brands and variants."""
    return I.score(named_rows(spark, sf)).select("query_id", "product_id", "score", "plausible")
