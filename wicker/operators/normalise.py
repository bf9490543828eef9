"""Raw transaction records to normalised baskets, with rejects and counters.

`headers`: seq (unique, input order), transaction_id, transaction_type,
occurred_at (text), status, customer_key, has_lines, source_system,
source_reference. `lines`: seq of the record, line_seq (order inside the
record), line_id, product_id, combination_id, quantity, line_status.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wicker.functions.cascade import first_match
from wicker.functions.keys import beside, blank, identity_order
from wicker.functions.ranking import mark_repeats
from wicker.params import NormaliseParams

ITEM = ["product_id", "combination_id"]


def parse_instant(column: str) -> Column:
    """UTC instant at millisecond precision; NULL without a date and an explicit zone."""
    zoned = F.col(column).rlike(r"^\d{4}-.*(?:Z|[+-]\d{2}:\d{2})$")
    return F.date_trunc("MILLISECOND", F.when(zoned, F.col(column).try_cast("timestamp")))


def split_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nested records (lines as an array) to headers and lines."""
    headers = records.select(
        "seq",
        "transaction_id",
        "transaction_type",
        "occurred_at",
        "status",
        "customer_key",
        F.col("lines").isNotNull().alias("has_lines"),
        F.col("source.system").alias("source_system"),
        F.col("source.reference").alias("source_reference"),
    )
    lines = records.select("seq", F.posexplode("lines").alias("line_seq", "line")).select(
        "seq", "line_seq", "line.*"
    )
    return headers, lines


def classify_transactions(headers: DataFrame, p: NormaliseParams) -> DataFrame:
    """Adds `instant` and `reject_code` (NULL = goes on to its lines)."""
    order, cart = F.col("transaction_type") == "order", F.col("transaction_type") == "cart"
    known = F.coalesce(order | cart, F.lit(False))
    status = F.coalesce(F.col("status"), F.lit(""))
    rules: list[tuple[Column, str]] = [
        (blank("transaction_id"), "INVALID_TRANSACTION_ID"),
        (~known, "INVALID_TRANSACTION_TYPE"),
        (F.col("instant").isNull(), "INVALID_OCCURRED_AT"),
    ]
    if p.window_from:
        rules.append((F.col("instant") < F.lit(p.window_from).cast("timestamp"), "OUTSIDE_DATA_WINDOW"))
    if p.window_to:
        rules.append((F.col("instant") > F.lit(p.window_to).cast("timestamp"), "OUTSIDE_DATA_WINDOW"))
    rules.append((order & ~status.isin(list(p.accepted_order_statuses)), "STATUS_NOT_ACCEPTED"))
    if p.accepted_cart_statuses is not None:
        rules.append((cart & ~status.isin(list(p.accepted_cart_statuses)), "STATUS_NOT_ACCEPTED"))
    if not p.allow_anonymous:
        rules.append((blank("customer_key"), "MISSING_CUSTOMER_KEY"))
    checked = headers.withColumn("instant", parse_instant("occurred_at")).withColumn(
        "reject_code", first_match(rules)
    )
    # Only a record that passes every check, its line list included, holds the
    # place of its key.
    marked = mark_repeats(
        checked,
        ["transaction_type", "transaction_id"],
        ["seq"],
        "__repeat",
        among=F.col("reject_code").isNull(),
        holders=F.col("has_lines"),
    )
    late = first_match(
        [(F.col("__repeat"), "DUPLICATE_TRANSACTION"), (~F.col("has_lines"), "INVALID_TRANSACTION")]
    )
    return marked.withColumn("reject_code", F.coalesce("reject_code", late)).drop("__repeat")


def line_code(p: NormaliseParams) -> Column:
    q = F.col("quantity")
    whole = q.isNotNull() & ~F.isnan(q) & (F.abs(q) != float("inf")) & (q > 0) & (q == F.floor(q))
    rules = [
        (blank("product_id"), "INVALID_PRODUCT_ID"),
        (F.col("combination_id").isNotNull() & blank("combination_id"), "INVALID_COMBINATION_ID"),
        (~whole, "INVALID_QUANTITY"),
    ]
    if p.rejected_line_statuses:
        rules.append((F.col("line_status").isin(list(p.rejected_line_statuses)), "LINE_STATUS_REJECTED"))
    return first_match(rules)


def classify_lines(lines: DataFrame, p: NormaliseParams) -> DataFrame:
    """Adds `line_code` (NULL = accepted)."""
    return lines.withColumn("line_code", line_code(p))


@dataclass
class Normalised:
    """Lazy frames of one normalisation run."""

    headers: DataFrame  # all records: instant, final reject_code, line counts
    lines: DataFrame  # lines of the records that passed their own checks, with line_code
    items: DataFrame  # accepted baskets, one row per product


def aggregate_products(accepted_lines: DataFrame) -> DataFrame:
    """One row per record and product; repeated lines add up."""
    return accepted_lines.groupBy("seq", *ITEM).agg(
        F.sum("quantity").cast("bigint").alias("quantity"), F.count(F.lit(1)).alias("line_count")
    )


def normalise(headers: DataFrame, lines: DataFrame, p: NormaliseParams) -> Normalised:
    classified = classify_transactions(headers, p)
    open_records = classified.filter(F.col("reject_code").isNull()).select("seq", "transaction_id")
    tagged = classify_lines(lines.join(open_records, "seq"), p)
    # good and bad lines in one pass: quantities by product, then counts by record
    fine = F.col("line_code").isNull()
    every = tagged.groupBy("seq", *ITEM).agg(
        F.sum(F.when(fine, F.col("quantity"))).cast("bigint").alias("quantity"),
        F.count_if(fine).alias("line_count"),
        F.count_if(~fine).alias("bad_count"),
    )
    products = every.filter("line_count > 0").drop("bad_count")
    sizes = every.groupBy("seq").agg(
        F.nullif(F.count_if(F.col("line_count") > 0), F.lit(0).cast("bigint")).alias("product_count"),
        F.sum("line_count").alias("accepted_lines"),
        F.sum("bad_count").alias("rejected_lines"),
    )
    final = first_match(
        [
            (F.col("product_count").isNull(), "NO_VALID_LINES"),
            (F.col("product_count") > p.max_products, "TOO_MANY_DISTINCT_PRODUCTS"),
        ]
    )
    done = (
        classified.join(sizes, "seq", "left")
        .withColumn("reject_code", F.coalesce("reject_code", final))
        .withColumn("accepted_lines", F.coalesce("accepted_lines", F.lit(0).cast("bigint")))
        .withColumn("rejected_lines", F.coalesce("rejected_lines", F.lit(0).cast("bigint")))
    )
    accepted = done.filter(F.col("reject_code").isNull()).select(
        "seq",
        "transaction_id",
        "transaction_type",
        F.col("instant").alias("occurred_at"),
        F.when(~blank("customer_key"), F.col("customer_key")).alias("customer_key"),
    )
    return Normalised(done, tagged, products.drop("line_count").join(accepted, "seq"))


def rejected_lines(n: Normalised) -> DataFrame:
    return n.lines.filter(F.col("line_code").isNotNull())


def accepted_lines(n: Normalised) -> DataFrame:
    return n.lines.filter(F.col("line_code").isNull()).drop("line_code")


def merged_lines(n: Normalised) -> DataFrame:
    """Lines merged into an earlier line of the same product, with the running quantity.

    Only products with a repeated line reach the window.
    """
    accepted = accepted_lines(n)
    repeated = aggregate_products(accepted).filter(F.col("line_count") > 1).select("seq", *ITEM)
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ["seq", *ITEM]]
    part = accepted.alias("l").join(repeated.alias("r"), reduce(lambda a, b: a & b, same), "left_semi")
    window = Window.partitionBy("seq", *ITEM).orderBy("line_seq")
    running = F.sum("quantity").over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        part.withColumn("aggregated_quantity", running.cast("bigint"))
        .withColumn("__n", F.row_number().over(window))
        .filter(F.col("__n") > 1)
        .drop("__n")
    )


def warnings(n: Normalised) -> DataFrame:
    """Tagged rows: code, seq, transaction_id and the details of the code."""
    empty = n.headers.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == 0)
    accepted = n.headers.filter(F.col("reject_code").isNull())
    per_record = accepted.select(
        "seq",
        "transaction_id",
        "source_system",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("rejected_lines") > 0, F.lit("PARTIAL_TRANSACTION")),
                    F.when(blank("customer_key"), F.lit("ANONYMOUS_TRANSACTION")),
                    F.when(
                        F.col("source_system").isNotNull()
                        & F.coalesce(F.col("source_reference") == "", F.lit(True)),
                        F.lit("SOURCE_REFERENCE_MISSING"),
                    ),
                )
            )
        ).alias("code"),
    ).withColumn(
        "source_system", F.when(F.col("code") == "SOURCE_REFERENCE_MISSING", F.col("source_system"))
    )
    merged = merged_lines(n).select(
        F.lit("PRODUCT_LINES_AGGREGATED").alias("code"),
        "seq",
        "transaction_id",
        *ITEM,
        "line_id",
        "aggregated_quantity",
    )
    frames = [per_record, merged, empty.select(F.lit("EMPTY_INPUT").alias("code"))]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def stats(n: Normalised, raw_lines: DataFrame) -> DataFrame:
    """The nine counters, one row."""
    ok = F.col("reject_code").isNull()
    zero = F.lit(0).cast("bigint")
    # lines count only where the record has a line list at all
    read = (
        raw_lines.groupBy("seq")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(n.headers.filter(F.col("has_lines")), "seq", "left_semi")
        .agg(F.coalesce(F.sum("n"), zero).alias("lines_read"))
    )
    records = n.headers.agg(
        F.count(F.lit(1)).alias("transactions_read"),
        F.count_if(ok).alias("transactions_accepted"),
        F.count_if(~ok).alias("transactions_rejected"),
        F.coalesce(F.sum("accepted_lines"), zero).alias("lines_accepted"),
        F.coalesce(F.sum("rejected_lines"), zero).alias("lines_rejected"),
        F.coalesce(F.sum(F.col("accepted_lines") - F.coalesce("product_count", zero)), zero).alias(
            "duplicate_product_lines_aggregated"
        ),
        F.count_if(ok & blank("customer_key")).alias("anonymous_transactions_accepted"),
    )
    products = (
        n.items.select(*ITEM).distinct().agg(F.count(F.lit(1)).alias("distinct_products_observed"))
    )
    return beside(records, read, products)


def in_output_order(items: DataFrame, mode: str = "occurred_at_then_transaction_id") -> DataFrame:
    """Total order for the edge of the pipeline."""
    head = ["transaction_id"] if mode == "transaction_id" else ["occurred_at", "transaction_id"]
    return items.orderBy(*head, *identity_order())


def contract_violations(items: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Keys that a dataset must hold once: transaction ids, products per transaction, rules."""

    def more_than_once(df: DataFrame, check: str, key: Column) -> DataFrame:
        counted = df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("occurrences"))
        return counted.filter(F.col("occurrences") > 1).select(F.lit(check).alias("check"), "key", "occurrences")

    record = ["seq"] if "seq" in items.columns else ["transaction_type"]
    ids = items.select("transaction_id", *record).distinct()
    found = more_than_once(ids, "TRANSACTION_ID", F.col("transaction_id")).unionByName(
        more_than_once(
            items,
            "TRANSACTION_PRODUCT",
            F.concat_ws("|", *[F.col(c).cast("string") for c in record], "transaction_id", "product_id",
                        F.coalesce("combination_id", F.lit(""))),
        )
    )
    if rules is not None:
        key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rules.columns])
        found = found.unionByName(more_than_once(rules, "RULE", key))
    return found
