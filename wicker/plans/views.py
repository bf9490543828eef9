"""Engine inputs derived from the test tables, in Spark.

The same derivations in SQL are in `oracle_views`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wicker.schemas import TABLES

WINDOW = ("1995-01-01 00:00:00", "2001-12-31 00:00:00")
NARROW = ("1996-01-01 00:00:00", "2000-12-31 00:00:00")
MODEL = "same-order-v1"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table, with zone-less timestamps read as UTC instants."""
    df = spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")
    naive = [f.name for f in df.schema.fields if f.dataType.simpleString() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


def text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def stamp(c: Column | str) -> Column:
    """Instants leave the queries as text, which is free of zone settings."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def mod(c: str, n: int) -> Column:
    return F.col(c) % n


def basket_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as baskets of base products.

    The transaction id is the key they are joined by, as it is: one shuffle by it serves
    the join and the baskets.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("transaction_id"),
        F.lit("order").alias("transaction_type"),
        F.col("o_orderdate").alias("occurred_at"),
        text("l_partkey").alias("product_id"),
        F.lit(None).cast("string").alias("combination_id"),
    )


def history_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as baskets of base products, with their customer."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        text("o_orderkey").alias("transaction_id"),
        text("o_custkey").alias("customer_key"),
        F.col("o_orderdate").alias("occurred_at"),
        text("l_partkey").alias("product_id"),
        F.lit(None).cast("string").alias("combination_id"),
    )


def mixed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and carts, with product variants."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        text("o_orderkey").alias("transaction_id"),
        F.when(F.col("o_orderpriority") == "5-LOW", "cart").otherwise("order").alias("transaction_type"),
        F.col("o_orderdate").alias("occurred_at"),
        text("l_partkey").alias("product_id"),
        F.when(mod("l_suppkey", 3) != 0, text(mod("l_suppkey", 3))).alias("combination_id"),
    )


def order_view(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders and lines as a shop source. Line numbers repeat, some values are bad."""
    orders = table(spark, sf_dir, "orders").select(
        text("o_orderkey").alias("order_id"),
        F.col("o_orderdate").alias("occurred_at"),
        F.col("o_orderstatus").alias("order_state"),
    )
    part = F.col("l_partkey")
    lines = table(spark, sf_dir, "lineitem").select(
        text("l_orderkey").alias("order_id"),
        F.when(part % 61 != 0, F.col("l_linenumber")).alias("line_id"),
        F.when(part % 59 == 0, F.lit("")).otherwise(text("l_partkey")).alias("product_id"),
        bad_quantity().alias("quantity"),
        "l_partkey",
        "l_suppkey",
        "l_quantity",
        "l_shipdate",
    )
    return orders, lines


def bad_quantity() -> Column:
    part = F.col("l_partkey")
    return (
        F.when(part % 83 == 0, F.lit(0.0))
        .when(part % 79 == 0, F.col("l_quantity") + 0.5)
        .otherwise(F.col("l_quantity"))
    )


def raw_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as raw records: bad ids, types and times, and a second copy of some."""
    orders = table(spark, sf_dir, "orders")
    with_lines = (
        table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    )
    flagged = orders.join(with_lines.withColumn("__lined", F.lit(True)), "o_orderkey", "left")
    key = F.col("o_orderkey")
    copies = flagged.withColumn(
        "copy", F.explode(F.when(key % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    )
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return copies.select(
        (key * 2 + F.col("copy")).alias("seq"),
        F.when(key % 101 == 0, F.lit(" ")).otherwise(text("o_orderkey")).alias("transaction_id"),
        F.when(key % 103 == 0, F.lit("refund"))
        .when((key % 150 == 0) & (F.col("copy") == 1), F.lit("cart"))
        .when(F.col("o_orderpriority") == "5-LOW", F.lit("cart"))
        .otherwise(F.lit("order"))
        .alias("transaction_type"),
        F.when(key % 107 == 0, F.concat(day, F.lit("T00:00:00")))
        .when(key % 7 == 0, F.concat(day, F.lit("T00:00:00-04:00")))
        .otherwise(F.concat(day, F.lit("T00:00:00.000Z")))
        .alias("occurred_at"),
        F.when((key % 250 == 0) & (F.col("copy") == 0), F.lit("X"))
        .otherwise(F.col("o_orderstatus"))
        .alias("status"),
        F.when(F.col("o_custkey") % 10 != 0, text("o_custkey")).alias("customer_key"),
        (F.col("__lined").isNotNull() | (key % 2 == 1)).alias("has_lines"),
        F.lit("shop").alias("source_system"),
        F.when(key % 19 != 0, F.concat(F.lit("order:"), text("o_orderkey"))).alias("source_reference"),
    )


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the raw records, a second set for the records that occur twice."""
    key, part, supp = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    copies = table(spark, sf_dir, "lineitem").withColumn(
        "copy", F.explode(F.when(key % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    )
    pad = lambda c, n: F.lpad(text(c), n, "0")
    return copies.select(
        (key * 2 + F.col("copy")).alias("seq"),
        F.concat(
            pad("l_linenumber", 2),
            pad("l_partkey", 12),
            pad("l_suppkey", 10),
            pad(F.col("l_quantity").cast("bigint"), 4),
            F.date_format("l_shipdate", "yyyyMMdd"),
        ).alias("line_seq"),
        F.concat_ws("-", text("l_linenumber"), text("l_partkey"), text("l_suppkey")).alias("line_id"),
        F.when(part % 97 == 0, F.lit("")).otherwise(text("l_partkey")).alias("product_id"),
        F.when(supp % 3 == 0, F.lit(None).cast("string"))
        .when(part % 89 == 0, F.lit(" "))
        .otherwise(text(supp % 3))
        .alias("combination_id"),
        bad_quantity().alias("quantity"),
        F.col("l_returnflag").alias("line_status"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mined edges with reliability, negative associations included."""
    from wicker.operators import basket as B
    from wicker.operators.reliability import with_reliability
    from wicker.operators.validate import EDGE, complete_edges
    from wicker.params import PairParams

    baskets = B.gather_stored(B.basket_contents(basket_items(spark, sf_dir), WINDOW))
    mined = B.same_order_candidates(baskets, PairParams(min_lift=0.0))
    full = with_reliability(B.as_relationships(mined, WINDOW, MODEL))
    return complete_edges(full).select(edge_seq().alias("seq"), *EDGE)


def ids() -> tuple[Column, Column]:
    return F.col("source_product_id").cast("bigint"), F.col("target_product_id").cast("bigint")


def edge_seq() -> Column:
    s, t = ids()
    return (s * 10000000 + t) * 2


def dirty_edges(spark: SparkSession, sf_dir: str, mined: DataFrame | None = None) -> DataFrame:
    """Edges, most of them spoilt in one of twenty ways; some occur twice. `mined` are the edges where they are stored."""
    s, t = ids()
    case = (s * 31 + t) % 31
    base = (edges(spark, sf_dir) if mined is None else mined).withColumn("m", case)
    m = F.col("m")

    def change(name: str, *cases: tuple[int, Column]) -> Column:
        out: Column | None = None
        for number, value in cases:
            out = F.when(m == number, value) if out is None else out.when(m == number, value)
        return out.otherwise(F.col(name)).alias(name)

    copies = F.when(m == 18, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    numeric = {c: F.when(~m.isin(19, 20, 21), F.col(c)).alias(c) for c in ("target_count", "total_transactions")}
    none = lambda t: F.lit(None).cast(t)
    other = [(n, none("double")) for n in (19, 20, 21)]
    other_counts = [(n, none("bigint")) for n in (19, 20, 21)]
    return base.withColumn("copy", F.explode(copies)).select(
        (F.col("seq") + F.col("copy")).alias("seq"),
        change("source_product_id", (0, F.lit(" "))),
        "source_combination_id",
        change("target_product_id", (1, F.lit("")), (2, F.col("source_product_id"))),
        "target_combination_id",
        change("relationship_type", (3, F.lit("bundle")), (19, F.lit("manual")), (20, F.lit("next_purchase")), (21, F.lit("manual"))),
        change("evidence_kind", (4, F.lit("rule")), (19, F.lit("rule")), (20, F.lit("transition")), (21, F.lit("rule"))),
        change("joint_count", (11, F.lit(0).cast("bigint")), (13, F.col("source_count") + 1), *other_counts),
        change("source_count", (12, F.lit(0).cast("bigint")), *other_counts),
        numeric["target_count"],
        numeric["total_transactions"],
        change("support", (8, F.lit(-0.1)), (14, F.col("support") + 1e-6), *other),
        change("confidence", (9, F.lit(1.2)), (15, F.col("confidence") + 1e-6), *other),
        change("lift", (10, F.lit(-1.0)), (16, F.col("lift") + 1e-6), *other),
        change("transition_count", (20, F.lit(3).cast("bigint"))),
        change("transition_probability", (20, F.lit(0.5))),
        "median_lag_days",
        change("rule_id", (21, F.lit("r1"))),
        change("rule_version", (21, F.lit("1"))),
        change("reliability", (7, F.lit(1.5)), (17, F.lit(float("nan")))),
        change("window_from", (5, F.lit("2002-06-01 00:00:00").cast("timestamp"))),
        "window_to",
        change("model_version", (6, F.lit(" "))),
    )


def valid_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wicker.operators import validate as C

    return C.accepted(C.validate(edges(spark, sf_dir)))


def knowledge(spark: SparkSession, sf_dir: str, valid: DataFrame | None = None) -> DataFrame:
    """Validated edges, and rule edges on some of the same pairs. `valid` are the validated edges where they are stored."""
    from wicker.operators.validate import EDGE

    s, t = ids()
    manual = F.when((s + t) % 6 == 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    both = (valid_edges(spark, sf_dir) if valid is None else valid).withColumn("__manual", F.explode(manual))
    flag = F.col("__manual")
    new = {
        "relationship_type": F.lit("manual"),
        "evidence_kind": F.lit("rule"),
        "rule_id": F.concat(F.lit("r-"), "source_product_id"),
        "rule_version": F.lit("1"),
        "reliability": F.when((s + t) % 12 == 0, F.lit(0.9)).otherwise(F.lit(0.25)),
    }
    gone = ["joint_count", "source_count", "target_count", "total_transactions", "support", "confidence", "lift"]

    def pick(c: str) -> Column:
        if c in new:
            return F.when(flag, new[c]).otherwise(F.col(c)).alias(c)
        return F.when(~flag, F.col(c)).alias(c) if c in gone else F.col(c)

    return both.select(*[pick(c) for c in EDGE])


def source_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One lookup per part."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("request_id"),
        text("p_partkey").alias("source_product_id"),
        F.lit(None).cast("string").alias("source_combination_id"),
        F.when(key % 4 == 0, F.array(F.lit("same_order")))
        .when(key % 4 == 1, F.array(F.lit("manual"), F.lit("same_cart")))
        .alias("relationship_types"),
        F.when(key % 3 != 0, (1 + key % 2).cast("int")).alias("limit"),
    )

MONEY = "decimal(20,6)"
AS_OF = "1999-01-01 00:00:00"
CONTEXT = {"shop_id": 1, "currency_id": 1, "country_id": 1, "group_id": 1, "customer_id": 0, "quantity": 10}


def catalog(spark: SparkSession, sf_dir: str, stored: bool = False):
    """Shop tables out of parts (products) and line items (variants).

    `stored` variants are read from the line items once for all tables made of them.
    """
    from wicker.session import stage_table
    from wicker.sources.catalog import Catalog

    key = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    pid = key.alias("product_id")
    product = part.select(
        pid,
        F.when(key % 9 == 0, F.lit("  ")).otherwise(F.concat(F.lit("REF-"), text("p_partkey"))).alias("reference"),
        F.col("p_type").alias("category_id"),
        F.when(key % 29 == 0, F.lit(None).cast("boolean")).otherwise(key % 17 != 0).alias("active"),
        F.when(key % 31 == 0, F.lit(None).cast("boolean")).otherwise(key % 13 != 0).alias("available_for_order"),
        F.when(key % 37 == 0, F.lit(None).cast("double"))
        .when(key % 43 == 0, F.lit(-5.0))
        .otherwise(F.col("p_retailprice"))
        .cast(MONEY)
        .alias("price"),
    )
    lang = part.withColumn("shop_id", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        pid,
        "shop_id",
        F.lit(1).alias("lang_id"),
        F.when(F.col("shop_id") == 1, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" (2)"))).alias("name"),
        F.concat(F.lit("<p>"), "p_brand", F.lit(" &amp; "), "p_type", F.lit("</p>")).alias("description_short"),
        F.concat(F.lit("<div>Size <b>"), text("p_size"), F.lit("</b></div>")).alias("description"),
    )
    shop = part.select(
        pid,
        F.when(key % 5 == 0, 1).otherwise(2).alias("shop_id"),
        (F.col("p_retailprice").cast(MONEY) + 10).cast(MONEY).alias("price"),
        F.when(key % 10 != 0, key % 15 != 0).alias("available_for_order"),
    )
    category = part.select(F.col("p_type").alias("category_id")).distinct().select(
        "category_id",
        F.lit(1).alias("shop_id"),
        F.lit(1).alias("lang_id"),
        F.when(F.col("category_id") == "ECONOMY", F.lit("  "))
        .otherwise(F.concat(F.lit("Cat "), "category_id"))
        .alias("name"),
    )
    v = F.col("v")
    lp = F.col("l_partkey")
    variant = (
        table(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_suppkey") % 3).alias("v")).distinct()
    )
    if stored:
        variant = stage_table(variant, "variants")
    attribute_rows = variant.select(
        F.when(lp % 4 == 0, -1 - lp).otherwise(lp).alias("product_id"),
        (lp * 10 + v + 1).alias("combination_id"),
        F.when(v == 2, F.lit(" "))
        .otherwise(F.concat(F.lit("REF-"), text("l_partkey"), F.lit("-"), text("v")))
        .alias("reference"),
        F.when(v != 1, v * 1.5).cast(MONEY).alias("price"),
        F.when(lp % 7 != 0, (v >= lp % 3).cast("int")).alias("default_on"),
    )
    attribute_shop = variant.select(
        (lp * 10 + v + 1).alias("combination_id"),
        F.when(v == 1, 1).otherwise(2).alias("shop_id"),
        F.lit(2.5).cast(MONEY).alias("price"),
    )
    base_stock = part.select(
        pid,
        F.lit(0).cast("bigint").alias("combination_id"),
        F.when(key % 11 == 0, 2).otherwise(1).alias("shop_id"),
        F.when(key % 19 != 0, (key * 7) % 50 - 5).alias("physical_quantity"),
    )
    comb = F.col("combination_id")
    variant_stock = attribute_rows.select(
        "product_id",
        "combination_id",
        F.when(comb % 7 == 0, 2).otherwise(1).alias("shop_id"),
        (comb % 13 - 2).alias("physical_quantity"),
    )
    of = variant.select(
        (lp * 10 + v + 1).alias("combination_id"),
        F.explode(F.array(1 + v, 10 + lp % 5)).alias("attribute_id"),
    )
    attribute_ids = of.select("attribute_id").distinct()
    group = F.when(F.col("attribute_id") < 10, 1).otherwise(2)
    attribute = attribute_ids.select("attribute_id", group.alias("group_id"))
    attribute_lang = attribute_ids.select(
        "attribute_id", F.lit(1).alias("lang_id"), F.concat(F.lit("Value "), text("attribute_id")).alias("name")
    )
    group_lang = attribute.select("group_id").distinct().select(
        "group_id",
        F.lit(1).alias("lang_id"),
        F.when(F.col("group_id") == 1, F.lit("Color")).otherwise(F.lit("Talla")).alias("name"),
    )
    return Catalog(
        product, lang, shop, category, attribute_rows, attribute_shop,
        base_stock.unionByName(variant_stock), of, attribute, attribute_lang, group_lang,
    )


def catalog_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One numeric reference per part, base or variant; some variants do not exist."""
    key, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        key.alias("request_id"),
        key.alias("product_id"),
        F.when(size % 3 == 0, F.lit(0)).otherwise(key * 10 + size % 4).cast("bigint").alias("combination_id"),
        (1 + size).cast("bigint").alias("quantity"),
        F.lit(1).cast("bigint").alias("shop_id"),
        F.lit(1).cast("bigint").alias("currency_id"),
        F.lit(1).cast("bigint").alias("country_id"),
        (key % 3).alias("group_id"),
        (key % 5).alias("customer_id"),
    )


def price_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as a price rule of its part."""
    part, supp, line, flag = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber"), F.col("l_returnflag")
    text_date = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "lineitem").select(
        ((F.col("l_orderkey") * 100000 + part) * 1000 + supp).alias("id"),
        part.alias("product_id"),
        F.when(line % 2 == 0, F.lit(0)).otherwise(part * 10 + supp % 3 + 1).cast("bigint").alias("combination_id"),
        F.when(line == 3, 1).when(line == 5, 2).otherwise(0).cast("bigint").alias("shop_id"),
        F.when(supp % 4 == 1, 1).otherwise(0).cast("bigint").alias("currency_id"),
        F.lit(0).cast("bigint").alias("country_id"),
        (supp % 3).alias("group_id"),
        F.when(line == 6, part % 5).otherwise(0).cast("bigint").alias("customer_id"),
        F.when(supp % 25 == 0, 9).otherwise(0).cast("bigint").alias("cart_id"),
        F.when(flag == "N", F.col("l_extendedprice")).otherwise(F.lit(-1.0)).cast(MONEY).alias("price"),
        F.col("l_quantity").cast("bigint").alias("from_quantity"),
        F.when((supp % 33 == 0) & (flag == "R"), F.lit(1.5))
        .when(supp % 35 == 0, F.lit(-0.1))
        .when(flag == "A", F.col("l_discount") * 1000)
        .when(flag == "R", F.col("l_discount"))
        .when(supp % 37 == 0, F.lit(0.1))
        .otherwise(F.lit(0.0))
        .cast(MONEY)
        .alias("reduction"),
        (line % 2).alias("reduction_tax"),
        F.when(flag == "R", F.lit("percentage"))
        .when(flag == "A", F.lit("amount"))
        .when(supp % 37 == 0, F.lit("gift"))
        .otherwise(F.lit("amount"))
        .alias("reduction_type"),
        F.when(supp % 10 == 0, none)
        .when(supp % 10 == 1, F.lit("0000-00-00 00:00:00"))
        .when((supp % 10 == 2) & (line == 4), F.lit("soon"))
        .otherwise(text_date("l_shipdate"))
        .alias("valid_from"),
        F.when(supp % 10 == 3, none)
        .otherwise(text_date(F.col("l_shipdate") + F.expr("INTERVAL '180' DAY")))
        .alias("valid_to"),
        F.when(line != 4, line % 3).alias("priority"),
    )


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price rules as relationship rules with a validity; odd dates are open ends."""
    source = F.col("product_id")
    return price_rules(spark, sf_dir).select(
        F.concat(F.lit("r-"), text("id")).alias("rule_id"),
        F.lpad(text(F.coalesce("priority", F.lit(0))), 4, "0").alias("rule_version"),
        text(source).alias("source_product_id"),
        text((source * 7 + F.col("group_id")) % 100 + 1).alias("target_product_id"),
        (0.5 + F.col("priority") / 10.0).alias("reliability"),
        F.when(F.col("valid_from").rlike("^[1-9]"), F.col("valid_from").try_cast("timestamp")).alias("valid_from"),
        F.col("valid_to").cast("timestamp").alias("valid_to"),
    )


def rule_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each product of each order at the time of the order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("at"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", text("l_partkey").alias("source_product_id"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderkey").alias("request_id"), "source_product_id", "at").distinct()


def truth_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text references: base products twice over, variants, and unusable ones."""
    key, size = F.col("p_partkey"), F.col("p_size")
    none = F.lit(None).cast("string")
    pid = F.when(key % 41 == 0, F.concat(F.lit("x"), text("p_partkey"))).otherwise(text("p_partkey"))
    combination = (
        F.when(size % 4 == 0, none)
        .when(size % 4 == 1, F.lit("0"))
        .when(size % 4 == 2, text(key * 10 + 1))
        .otherwise(text(key * 10 + 2))
    )
    both = F.explode(F.array(F.struct(pid.alias("p"), none.alias("c")), F.struct(pid.alias("p"), combination.alias("c"))))
    return table(spark, sf_dir, "part").select(both.alias("r")).select(
        F.col("r.p").alias("product_id"), F.col("r.c").alias("combination_id")
    )

REF_TIME = "2024-02-05 00:00:00"


def commercial_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Independent commercial flags per part; some parts are filed under another id."""
    key, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        F.when(key % 23 == 0, F.concat(F.lit("x"), text("p_partkey"))).otherwise(text("p_partkey")).alias("product_id"),
        F.lit(None).cast("string").alias("combination_id"),
        (key % 11 != 0).alias("available"),
        (key % 13 != 0).alias("sellable"),
        (key % 17 != 0).alias("active"),
        F.when(key % 5 == 0, "low_stock")
        .when(key % 5 == 1, "out_of_stock")
        .when(key % 5 == 2, "unknown")
        .otherwise("in_stock")
        .alias("stock_status"),
        F.when(key % 9 == 0, "EUR").otherwise("CLP").alias("currency"),
        F.when(key % 7 != 0, F.col("p_retailprice")).alias("amount"),
        F.when(size % 4 == 0, "high").when(size % 4 == 1, "medium").when(size % 4 == 2, "low").otherwise("unknown").alias(
            "margin_signal"
        ),
        F.when(size % 6 == 0, "incompatible").when(size % 6 == 1, "unknown").otherwise("compatible").alias("compatibility"),
    )


def reco_requests(spark: SparkSession, sf_dir: str, edges: DataFrame) -> DataFrame:
    """One recommendation request per part; its lists name targets of its own edges."""
    key = F.col("p_partkey")
    ends = edges.groupBy("source_product_id").agg(
        F.concat(F.min("target_product_id"), F.lit(":")).alias("lo"),
        F.concat(F.max("target_product_id"), F.lit(":")).alias("hi"),
    )
    parts = table(spark, sf_dir, "part").withColumn("source_product_id", text("p_partkey"))
    listed = lambda when, c: F.when(when, F.array(c))
    return parts.join(ends, "source_product_id", "left").select(
        key.alias("request_id"),
        "source_product_id",
        F.lit(None).cast("string").alias("source_combination_id"),
        F.lit(None).cast("array<string>").alias("relationship_types"),
        listed(key % 5 == 0, F.col("lo")).alias("excluded"),
        listed(key % 3 == 0, F.col("hi")).alias("cart"),
        listed(key % 2 == 0, F.col("lo")).alias("purchased"),
        listed(key % 2 == 1, F.col("lo")).alias("preferred"),
        listed(key % 4 == 0, F.col("hi")).alias("context_excluded"),
        (key % 2 == 0).alias("include_out_of_stock"),
        (key % 4 == 1).alias("in_stock_only"),
        F.when(key % 3 != 0, F.lit("CLP")).alias("budget_currency"),
        F.when(key % 3 != 0, 900.0 + F.col("p_size") * 4).alias("budget_max"),
        (1 + key % 3).cast("int").alias("limit"),
        F.when(key % 5 == 0, F.lit(None).cast("string"))
        .when(key % 7 == 3, F.concat(F.lit("new-"), text("p_partkey")))
        .otherwise(text(key % 149 + 1))
        .alias("customer_id"),
    )


def behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases, interests and rejections out of events, and purchases out of orders."""
    kind = F.col("event_type")
    events = table(spark, sf_dir, "events").filter(kind != "signup").select(
        text("user_id").alias("customer_id"),
        F.get_json_object("props", "$.k").alias("product_id"),
        F.lit(None).cast("string").alias("combination_id"),
        F.when(kind == "purchase", "purchase").when(kind == "error", "rejection").otherwise("interest").alias("action"),
        F.when(F.col("event_id") % 4 == 0, 2).when(F.col("event_id") % 4 != 1, 1).alias("cnt"),
        F.col("ts").alias("occurred_at"),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    bought = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        text("o_custkey").alias("customer_id"),
        text("l_partkey").alias("product_id"),
        F.lit(None).cast("string").alias("combination_id"),
        F.lit("purchase").alias("action"),
        F.lit(1).alias("cnt"),
        F.col("o_orderdate").alias("occurred_at"),
    )
    return events.unionByName(bought)


def product_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category, brand and price of every part."""
    key, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        text("p_partkey").alias("product_id"),
        F.lit(None).cast("string").alias("combination_id"),
        F.concat_ws("-", "p_type", text("p_size")).alias("category"),
        F.concat_ws("-", "p_brand", text(size % 10)).alias("brand"),
        F.when(key % 7 != 0, F.col("p_retailprice") * (key % 500)).alias("price"),
        F.when(key % 9 == 0, "EUR").otherwise("CLP").alias("currency"),
    )


def compatible_products(edges: DataFrame) -> DataFrame:
    return edges.select(
        F.col("source_product_id").alias("product_id"),
        F.col("source_combination_id").alias("combination_id"),
        F.col("target_product_id").alias("compatible_product_id"),
        F.col("target_combination_id").alias("compatible_combination_id"),
    ).distinct()


def spend_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        text("o_custkey").alias("customer_id"),
        F.when(F.col("o_custkey") % 8 == 0, "USD").otherwise("CLP").alias("currency"),
        F.col("o_totalprice").alias("amount"),
    )


def affinity_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event asks for its product; some users are new or not identified."""
    user = F.col("user_id")
    return table(spark, sf_dir, "events").select(
        user.alias("batch_id"),
        F.col("event_id").alias("seq"),
        F.when(user % 10 == 0, F.lit(None).cast("string"))
        .when(user % 7 == 3, F.concat(F.lit("new-"), text("user_id")))
        .otherwise(text("user_id"))
        .alias("customer_id"),
        F.get_json_object("props", "$.k").alias("product_id"),
        F.lit(None).cast("string").alias("combination_id"),
    )


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per part: its name, its reference, or its brand."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("query_id"),
        F.when(key % 3 == 0, F.col("p_name"))
        .when(key % 3 == 1, F.concat(F.lit("ref-"), text("p_partkey")))
        .otherwise(F.concat(F.lit(" "), "p_brand"))
        .alias("query"),
        (3 + key % 3).cast("int").alias("limit"),
        (key % 2 == 0).alias("include_out_of_stock"),
    )


def intent_name() -> Column:
    key, size = F.col("p_partkey") % 6, text("p_size")
    return (
        F.when(key == 0, F.concat(F.lit("Barra Olímpica "), size, F.lit(" kg")))
        .when(key == 1, F.concat(F.lit("Disco Bumper "), size, F.lit(" kg")))
        .when(key == 2, F.concat(F.lit("Kettlebell "), size, F.lit(" kg")))
        .when(key == 3, F.concat(F.lit("Barra Z "), F.col("p_name")))
        .when(key == 4, F.concat(F.lit("Colchoneta "), size, F.lit(" cm")))
        .otherwise(F.concat(F.col("p_name"), F.lit(" "), size, F.lit(" mm")))
    )


def intent_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search rows of a sports shop, one per part."""
    key = F.col("p_partkey")
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "part").select(
        key.alias("product_id"),
        F.lit(0).cast("bigint").alias("combination_id"),
        F.concat(F.lit("ref"), text("p_partkey")).alias("product_sku"),
        none.alias("combination_sku"),
        intent_name().alias("product_name"),
        F.concat(F.lit("<p>"), "p_type", F.lit(" "), "p_brand", F.lit("</p>")).alias("short_description"),
        none.alias("long_description"),
        none.alias("variant_label"),
        (key % 7 - 1).alias("physical_quantity"),
        F.lit(False).alias("has_variants"),
        F.lit(0).alias("is_default"),
        F.lit(None).cast("int").alias("default_on"),
    )


def intent_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same shop as resolved products."""
    key = F.col("p_partkey")
    weight = F.struct(F.lit("Peso").alias("group"), F.concat(text("p_size"), F.lit(" kg")).alias("value"))
    status = F.when(key % 31 == 0, "unknown").when(key % 7 > 1, "in_stock").otherwise("out_of_stock")
    return table(spark, sf_dir, "part").select(
        key.alias("product_id"),
        F.lit(0).cast("bigint").alias("combination_id"),
        intent_name().alias("name"),
        F.concat(F.lit("ref"), text("p_partkey")).alias("reference"),
        F.concat_ws(" ", "p_type", "p_brand").alias("description"),
        F.when(F.col("p_type") != "ECONOMY", F.concat(F.lit("Cat "), "p_type")).alias("category"),
        (key % 17 != 0).alias("active"),
        F.when(key % 37 != 0, F.col("p_retailprice")).alias("price"),
        status.alias("stock_status"),
        (status == "in_stock").alias("purchasable"),
        F.when(key % 5 == 0, F.array(weight)).alias("attributes"),
    )


def intent_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wish per part."""
    key, size = F.col("p_partkey"), text("p_size")
    k = key % 8
    return table(spark, sf_dir, "part").select(
        key.alias("query_id"),
        F.when(k == 0, F.concat(F.lit(" Barra  Olímpica "), size, F.lit(" kilos")))
        .when(k == 1, F.concat(F.lit("disco bumper "), size, F.lit("kg")))
        .when(k == 2, F.concat(F.lit("Pesa rusa "), size, F.lit(" KG")))
        .when(k == 3, F.col("p_name"))
        .when(k == 4, F.concat(F.lit("ref"), text("p_partkey")))
        .when(k == 5, F.lit("barra"))
        .when(k == 6, F.lit("Kettlebell"))
        .otherwise(F.concat(F.lit("colchoneta "), size, F.lit(",0 centímetros")))
        .alias("query"),
        F.when(key % 3 == 0, F.lit("para gimnasio standard")).alias("intended_use"),
        F.when(key % 4 == 0, F.col("p_type")).alias("category_wanted"),
        F.when(key % 5 == 0, F.array("p_brand")).alias("preferred"),
        F.when(key % 6 == 0, F.array(text("p_partkey"))).alias("excluded"),
        (key % 9 == 0).alias("in_stock_only"),
        F.when(key % 2 == 0, F.lit(10)).alias("limit"),
    )


def named_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wish per part; most name a brand or a variant."""
    key, size, brand, name = F.col("p_partkey"), text("p_size"), F.col("p_brand"), F.col("p_name")
    k = key % 6
    return table(spark, sf_dir, "part").select(
        key.alias("query_id"),
        F.when(k == 0, F.concat(F.lit("Disco  Bumper "), brand, F.lit(" "), size, F.lit(" KG")))
        .when(k == 1, F.concat(brand, F.lit(" "), name))
        .when(k == 2, F.concat(F.lit("peso "), size, F.lit(" kg de "), brand, F.lit(", no de "), name))
        .when(k == 3, F.concat(name, F.lit(" de "), text(F.col("p_size") + 1), F.lit(" kg")))
        .when(k == 4, name)
        .otherwise(F.concat(F.lit("ref"), text("p_partkey"), F.lit(" "), brand))
        .alias("query"),
        F.lit(None).cast("string").alias("intended_use"),
        F.lit(None).cast("string").alias("category_wanted"),
        F.array().cast("array<string>").alias("preferred"),
    )


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands and variants of the catalogue as phrases."""
    key, size = F.col("p_partkey"), text("p_size")
    fifth = F.when(key % 5 == 0, F.array(F.concat(F.lit("Peso "), size, F.lit(" kg")), F.concat(size, F.lit(" kg"))))
    return table(spark, sf_dir, "part").select(
        F.explode(
            F.concat(
                F.array(F.struct(F.lit("brand").alias("kind"), F.col("p_brand").alias("phrase"))),
                F.when(key % 7 == 0, F.array(F.struct(F.lit("brand").alias("kind"), F.concat("p_name", F.lit(" de luxe")).alias("phrase"))))
                .otherwise(F.array().cast("array<struct<kind:string,phrase:string>>")),
                F.coalesce(
                    F.transform(fifth, lambda p: F.struct(F.lit("variant").alias("kind"), p.alias("phrase"))), F.array().cast("array<struct<kind:string,phrase:string>>")
                ),
            )
        ).alias("p")
    ).select("p.*")
