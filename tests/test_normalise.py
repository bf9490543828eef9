from pyspark.sql import functions as F

from wicker.operators import normalise as N
from wicker.params import NormaliseParams
from wicker.sources import orders as O

SCHEMA = """seq bigint, transaction_id string, transaction_type string, occurred_at string, status string,
  customer_key string, lines array<struct<line_id string, product_id string, combination_id string, quantity double,
  line_status string>>, source struct<system string, reference string>"""
P = NormaliseParams(
    ("paid", "delivered"), ("active",), ("cancelled",), 3, "2025-01-01 00:00:00", "2025-12-31 23:59:59"
)
AT = "2025-03-01T10:00:00.000Z"


def line(product, quantity=1.0, combination=None, status=None, line_id="l"):
    return (line_id, product, combination, quantity, status)


def record(seq, tid="t", kind="order", at=AT, status="paid", customer="c", lines=(), source=("shop", "r")):
    return (seq, tid, kind, at, status, customer, None if lines is None else [tuple(x) for x in lines], source)


def run(spark, records, p=P):
    headers, lines = N.split_records(spark.createDataFrame(records, SCHEMA))
    return N.normalise(headers, lines, p), lines


def codes(n):
    return {r.seq: r.reject_code for r in n.headers.collect()}


def test_first_failing_rule_names_the_rejection(spark):
    good = [line("A")]
    records = [
        record(1, " ", lines=good),
        record(2, "b", kind="refund", lines=good),
        record(3, "c", at="2025-03-01T10:00:00", lines=good),
        record(4, "d", at="2024-12-31T23:59:59.999Z", lines=good),
        record(5, "e", at="2024-12-31T20:30:00-04:00", lines=good),
        record(6, "f", status="new", lines=good),
        record(7, "g", kind="cart", status="paid", lines=good),
        record(8, "h", kind="cart", status="active", lines=good),
        record(9, "i", lines=[line("")]),
        record(10, "j", lines=[line(x) for x in "ABCD"]),
        record(11, "k", lines=None),
        record(12, "l", customer=None, lines=good),
    ]
    n, _ = run(spark, records)
    assert codes(n) == {
        1: "INVALID_TRANSACTION_ID",
        2: "INVALID_TRANSACTION_TYPE",
        3: "INVALID_OCCURRED_AT",
        4: "OUTSIDE_DATA_WINDOW",
        5: None,
        6: "STATUS_NOT_ACCEPTED",
        7: "STATUS_NOT_ACCEPTED",
        8: None,
        9: "NO_VALID_LINES",
        10: "TOO_MANY_DISTINCT_PRODUCTS",
        11: "INVALID_TRANSACTION",
        12: None,
    }
    strict = NormaliseParams(("paid",), allow_anonymous=False)
    assert codes(run(spark, [record(1, customer=" ", lines=good)], strict)[0]) == {1: "MISSING_CUSTOMER_KEY"}


def test_duplicates_keep_the_first_good_record(spark):
    good = [line("A")]
    n, _ = run(
        spark,
        [
            record(1, "a", status="new", lines=good),
            record(2, "a", lines=good),
            record(3, "a", lines=good),
            record(4, "b", lines=[line("")]),
            record(5, "b", lines=good),
            record(6, "a", kind="cart", status="active", lines=good),
            record(7, "c", lines=None),
            record(8, "c", lines=good),
        ],
    )
    assert codes(n) == {
        1: "STATUS_NOT_ACCEPTED",
        2: None,
        3: "DUPLICATE_TRANSACTION",
        4: "NO_VALID_LINES",
        5: "DUPLICATE_TRANSACTION",
        6: None,
        7: "INVALID_TRANSACTION",
        8: None,
    }


def test_one_key_with_most_of_the_rows(spark):
    n, _ = run(spark, [record(i, "same", lines=[line("A")]) for i in range(1, 400)])
    got = codes(n)
    assert got[1] is None and set(got.values()) == {None, "DUPLICATE_TRANSACTION"}


def test_lines_merge_and_warn(spark):
    lines = [line("A", 2.0, line_id="1"), line("A", 3.0, line_id="2"), line("A", 1.0, "v", line_id="3"),
             line("B", 1.5), line("C", 1.0, " "), line("D", 1.0, status="cancelled")]
    n, raw = run(spark, [record(1, lines=lines, customer=None, source=("shop", None))])
    items = {(r.product_id, r.combination_id): r.quantity for r in n.items.collect()}
    assert items == {("A", None): 5, ("A", "v"): 1}
    assert sorted(r.line_code for r in N.rejected_lines(n).collect()) == [
        "INVALID_COMBINATION_ID", "INVALID_QUANTITY", "LINE_STATUS_REJECTED",
    ]
    warned = {r.code: r for r in N.warnings(n).collect()}
    assert set(warned) == {"PARTIAL_TRANSACTION", "ANONYMOUS_TRANSACTION", "SOURCE_REFERENCE_MISSING", "PRODUCT_LINES_AGGREGATED"}
    assert (warned["PRODUCT_LINES_AGGREGATED"].line_id, warned["PRODUCT_LINES_AGGREGATED"].aggregated_quantity) == ("2", 5)
    s = N.stats(n, raw).first()
    assert (s.lines_read, s.lines_accepted, s.lines_rejected, s.duplicate_product_lines_aggregated) == (6, 3, 3, 1)
    assert s.distinct_products_observed == 2 and s.anonymous_transactions_accepted == 1


def test_empty_input_warns(spark):
    n, _ = run(spark, [])
    assert [r.code for r in N.warnings(n).collect()] == ["EMPTY_INPUT"]


def test_source_cleansing_with_varying_states(spark):
    data = [
        ("1", "2025-01-01", "5", 1, "10", 1.0),
        ("1", "2025-01-01", "9", 2, "11", 1.0),
        ("1", "2025-01-01", "5", 2, "11", 1.0),
        ("1", "2025-01-01", "5", 3, "", 1.0),
        ("1", "2025-01-01", "5", 4, "12", 1.0),
        ("2", "2025-01-02", "9", 5, "10", 1.0),
        ("2", "2025-01-02", "5", 6, "10", 1.0),
        ("3", "2025-01-03", "5", 7, "10", 0.0),
        (None, "2025-01-03", "5", 8, "10", 1.0),
    ]
    df = spark.createDataFrame(
        data, "order_id string, at string, order_state string, line_id int, product_id string, quantity double"
    ).withColumn("occurred_at", F.col("at").cast("timestamp"))
    tagged = O.tag_lines(df, ["5"], ["12"], states_vary=True)
    s = O.read_stats(tagged).first()
    assert (s.source_orders_read, s.source_lines_read, s.source_orders_excluded) == (3, 9, 1)
    assert (s.source_lines_excluded, s.source_duplicate_lines_excluded, s.source_products_excluded) == (7, 1, 1)
    assert {r.transaction_id: r.line_count for r in O.transaction_headers(tagged).collect()} == {"1": 2, "3": 0}


def test_a_time_needs_a_date(spark):
    from wicker.operators.normalise import parse_instant

    rows = spark.createDataFrame([("T10:00:00Z",), ("10:00:00Z",), ("2025-03-01T10:00:00Z",), ("2025-03-01T10:00:00",)], "t string")
    assert [r[0] is None for r in rows.select(parse_instant("t")).collect()] == [True, True, False, True]
