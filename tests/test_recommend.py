import pytest
from pyspark.sql import functions as F

from wicker.operators import affinity as A
from wicker.operators import commercial as M
from wicker.operators import personalise as X
from wicker.params import AffinityParams, EligibilityParams, PersonalParams
from tests.test_snapshot import edge, frame

REQUEST = """request_id int, source_product_id string, source_combination_id string, relationship_types array<string>,
 excluded array<string>, cart array<string>, purchased array<string>, preferred array<string>,
 include_out_of_stock boolean, budget_currency string, budget_max double, limit int, customer_id string"""
DATA = """product_id string, combination_id string, available boolean, sellable boolean, active boolean, stock_status string,
 currency string, amount double, margin_signal string, compatibility string"""


def request(spark, **over):
    row = dict(
        request_id=1, source_product_id="A", source_combination_id=None, relationship_types=None, excluded=None, cart=None,
        purchased=None, preferred=None, include_out_of_stock=None, budget_currency=None, budget_max=None, limit=None,
        customer_id="c1",
    )
    row.update(over)
    return spark.createDataFrame([tuple(row.values())], REQUEST)


def data(spark, *products):
    base = ("in_stock", "CLP", 100.0, "unknown", "compatible")
    rows = []
    for pid, over in products:
        row = dict(zip(["stock_status", "currency", "amount", "margin_signal", "compatibility"], base))
        row |= dict(available=True, sellable=True, active=True) | over
        rows.append(
            (pid, None, row["available"], row["sellable"], row["active"], row["stock_status"], row["currency"],
             row["amount"], row["margin_signal"], row["compatibility"])
        )
    return spark.createDataFrame(rows, DATA)


def codes(df):
    return {r.target_product_id: r.reject_code for r in df.collect()}


def test_eligibility_codes(spark):
    edges = frame(spark, *[edge("A", t) for t in "BCDEFGHIJKL"]).drop("seq")
    products = data(
        spark, ("B", {}), ("C", {}), ("D", {}), ("E", {"active": False}), ("F", {"sellable": False}),
        ("G", {"available": False}), ("H", {"compatibility": "incompatible"}), ("I", {"amount": 500.0}),
        ("J", {"compatibility": "unknown"}), ("L", {"amount": 500.0, "currency": "EUR"}),
    )
    asked = request(spark, excluded=["C:"], cart=["D:"], budget_currency="CLP", budget_max=200.0)
    assert codes(M.judge(asked, edges, products)) == {
        "B": None, "C": "EXPLICITLY_EXCLUDED", "D": "ALREADY_IN_CART", "E": "INACTIVE", "F": "NOT_SELLABLE",
        "G": "OUT_OF_STOCK", "H": "INCOMPATIBLE", "I": "ABOVE_BUDGET", "J": None, "K": "MISSING_COMMERCIAL_DATA", "L": None,
    }
    strict = EligibilityParams(reject_unknown_compatibility=True, exclude_cart=False)
    got = codes(M.judge(asked, edges, products, strict))
    assert got["J"] == "UNKNOWN_COMPATIBILITY" and got["D"] is None


def test_score_and_rank(spark):
    edges = frame(spark, edge("A", "B"), edge("A", "C", reliability=0.8), edge("A", "C", reliability=0.7, kind="same_cart"))
    products = data(spark, ("B", {"margin_signal": "high"}), ("C", {"stock_status": "low_stock"}))
    judged = M.judge(request(spark), edges.drop("seq"), products)
    top = {r.target_product_id: r for r in M.commercial_top(M.scored_candidates(judged)).collect()}
    relation = 20 * 0.5 + 15 * (0.25 / 4) + 10 * 1
    assert top["B"].total == pytest.approx(45 * 0.5 + relation + 5 + 5 + 3)
    assert top["C"].total == pytest.approx(45 * 0.8 + relation + 2 + 5)
    assert (top["C"].rank, top["B"].rank) == (1, 2) and top["C"].warnings == ["LOW_STOCK"]
    stats = M.commercial_stats(request(spark), judged).withColumn("ok", M.stats_consistent()).first()
    assert (stats.relationships_read, stats.duplicates_removed, stats.eligible_candidates, stats.ok) == (3, 1, 2, True)


EVIDENCE = """customer_id string, product_id string, combination_id string, kind string, cnt int, at string,
 median_interval_days double, candidate_price double, currency string"""


def signals(spark, rows, ref="2026-07-22 12:00:00"):
    full = [("c", "P", None, *r, *([None] * (6 - len(r)))) for r in rows]
    df = spark.createDataFrame(full, EVIDENCE).withColumn("occurred_at", F.col("at").cast("timestamp"))
    profile = spark.createDataFrame([("c", "CLP", 100.0, 50.0)], "customer_id string, currency string, max_spend double, avg_spend double")
    return A.with_score(A.with_signals(A.evidence_from_rows(df, ref), profile, ref)).first()


def test_affinity_signals_and_score(spark):
    got = signals(
        spark,
        [("direct", 2, "2020-01-01"), ("product_interest", 1, "2026-07-01"), ("product_interest", 5, "2026-01-01"),
         ("category_rejection", None, "2026-07-20"), ("repeat", 3, "2026-01-01", 10.0), ("price", None, None, None, 80.0, "CLP")],
    )
    want = {"DIRECT_PRODUCT_PURCHASE": 2 / 3, "RECENT_PRODUCT_INTEREST": 1 / 3, "REPEAT_PURCHASE_PATTERN": 0.6, "OBSERVED_SPEND_FIT": 1.0}
    for code, value in want.items():
        assert got[f"s_{code}"] == pytest.approx(value)
    assert got.s_CATEGORY_REJECTION == 1.0 and got.s_BRAND_PURCHASE is None
    p = AffinityParams()
    plus = sum(want[c] * p.positive_weights()[c] for c in want)
    assert got.affinity_score == pytest.approx((plus - 0.25) / sum(p.positive_weights().values()))
    assert (got.signal_types, got.evidence_count, got.confidence) == (5, 8, "high")


def test_without_reference_time(spark):
    got = signals(spark, [("product_interest", 1, "2026-07-01"), ("product_rejection", 1, "2000-01-01")], None)
    assert got.s_RECENT_PRODUCT_INTEREST is None and got.s_PRODUCT_REJECTION == 1.0
    assert got.affinity_warnings == ["REFERENCE_TIME_UNAVAILABLE"] and got.affinity_score == 0.0


def personal(spark, affinity_rows, **over):
    edges = frame(spark, edge("A", "B", reliability=0.9), edge("A", "C", reliability=0.8)).drop("seq")
    products = data(spark, ("B", {}), ("C", {}))
    top = M.commercial_top(M.scored_candidates(M.judge(request(spark, **over), edges, products)))
    asked = spark.createDataFrame(
        [(1, 1, "c1", "B", None), (1, 2, "c1", "C", None)],
        "batch_id int, seq int, customer_id string, product_id string, combination_id string",
    )
    rows = [("c1", p, None, k, n, None, None, None, None) for p, k, n in affinity_rows]
    df = spark.createDataFrame(rows, EVIDENCE).withColumn("occurred_at", F.col("at").cast("timestamp"))
    profile = spark.createDataFrame([], "customer_id string, currency string, max_spend double, avg_spend double")
    table = A.affinity_table(asked, A.with_score(A.with_signals(A.evidence_from_rows(df, None), profile, None)))
    return X.personalise(top, table, PersonalParams())


def order(df):
    return [r.target_product_id for r in X.kept(df).orderBy("personalised_rank").collect()]


def test_personalised_order(spark):
    assert order(personal(spark, [("Z", "direct", 1)])) == ["B", "C"]
    assert order(personal(spark, [("C", "direct", 3), ("C", "category", 5)])) == ["C", "B"]
    assert order(personal(spark, [("Z", "direct", 1)], preferred=["C:"])) == ["C", "B"]
    rejected = personal(spark, [("B", "product_rejection", 1)])
    assert order(rejected) == ["C"]
    assert X.excluded(rejected).first().exclusion_code == "EXPLICIT_PRODUCT_REJECTION"


def test_spend_is_held_against_its_own_currency(spark):
    from wicker.operators import affinity as A

    rows = spark.createDataFrame(
        [("c", "p", None, "price", None, None, None, 9.0, "CLP"), ("d", "p", None, "price", None, None, None, 9.0, "EUR")],
        "customer_id string, product_id string, combination_id string, kind string, cnt int, occurred_at timestamp, "
        "median_interval_days double, candidate_price double, currency string",
    )
    orders = spark.createDataFrame([("c", "CLP", 10.0), ("c", "USD", 5.0), ("d", "CLP", 10.0)], "customer_id string, currency string, amount double")
    got = A.with_signals(A.evidence_from_rows(rows, None), A.customer_profile(orders), None).collect()
    broken = rows.limit(1).withColumn("cnt", F.lit(-2)).withColumn("kind", F.lit("repeat"))
    spoilt = A.with_signals(A.evidence_from_rows(rows.union(broken), None), A.customer_profile(orders), None).collect()
    assert [r.affinity_warnings for r in spoilt if r.customer_id == "c"] == [["INVALID_EVIDENCE_IGNORED"]]
    assert [r.s_OBSERVED_SPEND_FIT for r in spoilt if r.customer_id == "c"] == [None]
    assert sorted((r.customer_id, r.s_OBSERVED_SPEND_FIT, r.affinity_warnings) for r in got) == [("c", 1.0, []), ("d", None, ["CURRENCY_MISMATCH"])]


def test_warnings_of_the_evidence_source_come_first(spark):
    table = spark.createDataFrame(
        [("b1", True, "NO_CUSTOMER_HISTORY"), ("b1", True, "NO_CUSTOMER_HISTORY"), ("b2", False, "CUSTOMER_NOT_IDENTIFIED"), ("b3", True, None), ("b4", True, None)],
        "batch_id string, known_customer boolean, batch_warning string",
    )
    provider = spark.createDataFrame([("b1",), ("b1",), ("b2",), ("b3",), ("b9",)], "batch_id string")
    got = sorted((r["batch_id"], r["position"], r["code"]) for r in A.batch_warnings(table, provider).collect())
    own = "AFFINITY_PROVIDER_WARNING"
    assert got == [("b1", 1, own), ("b1", 2, own), ("b1", 3, "NO_CUSTOMER_HISTORY"), ("b2", 1, "CUSTOMER_NOT_IDENTIFIED"), ("b3", 1, own)]
    assert sorted((r["batch_id"], r["code"]) for r in A.batch_warnings(table).collect()) == [("b1", "NO_CUSTOMER_HISTORY"), ("b2", "CUSTOMER_NOT_IDENTIFIED")]


def test_history_is_read_once_and_summed_from_days(spark, tmp_path):
    rows = [
        ("c", "P", None, "purchase", 2, "2026-01-01 08:00:00"), ("c", "P", None, "purchase", None, "2026-01-01 09:00:00"),
        ("c", "P", None, "interest", 1, "2026-01-03 00:00:00"), ("c", "P", None, "purchase", 1, "2026-01-11 00:00:00"),
        ("c", "Q", "1", "purchase", 1, "2026-01-05 00:00:00"), ("c", "Q", None, "rejection", 1, "2026-01-06 00:00:00"),
        ("d", "P", None, "purchase", 9, "2026-01-01 00:00:00"),
    ]
    history = spark.createDataFrame(rows, "customer_id string, product_id string, combination_id string, action string, cnt int, at string")
    history.withColumn("occurred_at", F.col("at").cast("timestamp")).write.parquet(f"{tmp_path}/history")
    history = spark.read.parquet(f"{tmp_path}/history")
    item = "product_id string, combination_id string"
    products = spark.createDataFrame(
        [("P", None, "k", "b", 5.0, "CLP"), ("Q", "1", "k", None, None, None), ("R", None, "k", "b", None, None)],
        f"{item}, category string, brand string, price double, currency string",
    )
    compatible = spark.createDataFrame([("R", None, "Q", "1"), ("R", None, "P", None)], f"{item}, compatible_product_id string, compatible_combination_id string")
    asked = spark.createDataFrame([("c", "P", None), ("c", "R", None), ("c", "Q", None), ("e", "P", None)], f"customer_id string, {item}")
    found = A.evidence_from_history(asked, history, products, compatible, "2026-01-20 00:00:00")
    assert not any(f"{tmp_path}" in f for f in found.inputFiles())
    got = {(r.customer_id, r.product_id): r for r in found.collect()}
    assert set(got) == {("c", "P"), ("c", "R"), ("c", "Q")}
    own, other = got["c", "P"], got["c", "R"]
    assert (own.direct_count, str(own.direct_last), own.product_interest_count, own.repeat_count, own.repeat_median_days) == (4, "2026-01-11 00:00:00", 1, 2, 10.0)
    assert (other.direct_count, other.category_count, other.brand_count, other.category_interest_count) == (None, 5, 4, 1)
    assert (other.owned_compatible_count, str(other.owned_compatible_last), other.repeat_count) == (2, "2026-01-11 00:00:00", None)
    assert (got["c", "Q"].product_rejection_count, got["c", "Q"].combination_id, got["c", "Q"].category_count) == (1, None, None)
