import itertools
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from wicker.operators import basket as B
from wicker.operators.reliability import with_reliability
from wicker.params import PairParams, ReliabilityParams

WINDOW = ("2025-01-01 00:00:00", "2025-12-31 00:00:00")


def items(spark, baskets, kind="order", at="2025-06-01 00:00:00"):
    data = [(t, kind, at, p, c) for t, products in baskets.items() for p, c in products]
    df = spark.createDataFrame(
        data, "transaction_id string, transaction_type string, at string, product_id string, combination_id string"
    )
    return df.withColumn("occurred_at", F.col("at").cast("timestamp")).drop("at")


def plain(products):
    return [(p, None) for p in products]


def brute_force(baskets):
    counts = Counter()
    for products in baskets.values():
        for a, b in itertools.permutations(sorted(set(products)), 2):
            counts[(a, b)] += 1
    return counts


def found_pairs(baskets):
    return {(r[0], r[2]): r[4] for r in B.pair_counts(baskets).select(*B.SOURCE, *B.TARGET, "joint_count").collect()}


def test_hand_worked_evidence(spark):
    data = {"1": plain("AB"), "2": plain("AB"), "3": plain("AC"), "4": plain("A")}
    got = B.evidence(B.gather(B.basket_contents(items(spark, data), WINDOW)))
    edge = got.filter("source_product_id = 'A' AND target_product_id = 'B'").first()
    assert (edge.joint_count, edge.source_count, edge.target_count, edge.total_transactions) == (2, 3, 2, 3)
    assert edge.support == 2 / 3 and edge.confidence == 2 / 3 and edge.lift == (2 / 3) / (2 / 3)


def test_carts_window_and_single_baskets_do_not_count(spark):
    orders = items(spark, {"1": plain("AB"), "2": plain("A")})
    carts = items(spark, {"3": plain("AB")}, kind="cart")
    late = items(spark, {"4": plain("AB")}, at="2026-01-01 00:00:00")
    stats = B.cooccurrence_stats(orders.union(carts).union(late), WINDOW, PairParams(min_joint_count=1)).first()
    assert stats.transactions_read == 4 and stats.orders_read == 3 and stats.carts_ignored == 1
    assert stats.orders_outside_data_window == 1 and stats.single_product_orders_ignored == 1
    assert stats.orders_processed == 1 and stats.directed_pairs_observed == 2 and stats.candidates_accepted == 2
    assert stats.orders_read == (
        stats.orders_outside_data_window + stats.single_product_orders_ignored + stats.orders_processed
    )


def test_variants_are_products_of_their_own(spark):
    data = {"1": [("A", None), ("A", "1"), ("A", "2")]}
    assert B.pair_counts(B.gather(B.basket_contents(items(spark, data), WINDOW))).count() == 6


def test_baskets_of_any_size_match_brute_force(spark):
    """One basket holds most of the rows and is far larger than a block."""
    rng = random.Random(7)
    data = {str(i): [f"p{rng.randrange(30)}" for _ in range(rng.randrange(1, 9))] for i in range(60)}
    data["huge"] = [f"p{i}" for i in range(B.BLOCK * 3 + 5)]
    data["edge"] = [f"p{i}" for i in range(B.BLOCK)]
    data["over"] = [f"p{i}" for i in range(B.BLOCK + 1)]
    source = items(spark, {t: plain(v) for t, v in data.items()})
    baskets = B.gather(B.basket_contents(source, WINDOW))
    assert found_pairs(baskets) == dict(brute_force(data))
    assert found_pairs(B.gather_stored(B.basket_contents(source, WINDOW))) == dict(brute_force(data))
    eligible = [set(v) for v in data.values() if len(set(v)) > 1]
    counts = {r.product_id: r.basket_count for r in B.product_counts(baskets).collect()}
    assert counts == dict(Counter(p for v in eligible for p in v))
    assert baskets.total().first()[0] == len(eligible)


def test_result_does_not_depend_on_partitions(spark):
    data = {str(i): plain([f"p{(i * k) % 11}" for k in range(1, 6)]) for i in range(40)}
    source = items(spark, data)
    first = found_pairs(B.gather(B.basket_contents(source, WINDOW)))
    second = found_pairs(B.gather(B.basket_contents(source.repartition(7).orderBy(F.rand(3)), WINDOW)))
    assert first == second and all(first[(b, a)] == n for (a, b), n in first.items())


def test_top_k_and_limit_warning(spark):
    data = {"1": plain("ABCD"), "2": plain("AB"), "3": plain("AC")}
    baskets = B.gather(B.basket_contents(items(spark, data), WINDOW))
    p = PairParams(min_joint_count=1, min_lift=0, max_per_source=2)
    top = B.same_order_candidates(baskets, p)
    assert [r.target_product_id for r in top.filter("source_product_id = 'A'").orderBy("source_rank").collect()] == ["B", "C"]
    lost = B.per_source_rejections(B.with_thresholds(B.evidence(baskets), p), 2)
    assert {(r.source_product_id, r.rejected) for r in lost.collect()} == {("A", 1), ("B", 1), ("C", 1), ("D", 1)}


def test_reliability_formula(spark):
    import math

    df = spark.createDataFrame([(0.6, 1.5, 0.3, 12)], "confidence double, lift double, support double, joint_count bigint")
    want = 0.5 * 0.6 + 0.25 * (1 - 1 / 1.5) + 0.1 * 0.3 + 0.15 * (1 - math.exp(-1.2))
    assert with_reliability(df).first().reliability == pytest.approx(want, abs=1e-15)


def test_reliability_refuses_other_evidence_and_bad_weights(spark):
    df = spark.createDataFrame(
        [("rule", 0.6, 1.5, 0.3, 12)],
        "evidence_kind string, confidence double, lift double, support double, joint_count bigint",
    )
    with pytest.raises(Exception, match="co_occurrence"):
        with_reliability(df).collect()
    with pytest.raises(ValueError):
        ReliabilityParams(0.5, 0.5, 0.5, 0.5)


def test_pairs_under_the_threshold_are_not_joined(spark, monkeypatch):
    rows = [(t, "order", None, p, None) for t in range(40) for p in ("1", "2", f"x{t}")]
    items = spark.createDataFrame(rows, "transaction_id int, transaction_type string, occurred_at timestamp, product_id string, combination_id string")
    baskets = B.gather(B.basket_contents(items.withColumn("transaction_id", F.col("transaction_id").cast("string"))))
    seen, whole = [], B.metrics
    monkeypatch.setattr(B, "metrics", lambda rows: seen.append(rows.count()) or whole(rows))
    assert B.same_order_candidates(baskets, PairParams()).count() == 2
    assert seen == [2]  # both directions of one pair of 81


def test_a_pair_is_counted_where_the_lists_of_a_product_meet(spark):
    data = {str(t): plain("ABC" if t % 2 else "ABD") for t in range(30)} | {"large": plain([f"p{n:03}" for n in range(150)])}
    baskets = B.gather(B.basket_contents(items(spark, data), WINDOW))
    counted = B.unordered_pair_counts(baskets)
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(a#\d+, b#", plan)
    want = Counter(p for basket in data.values() for p in itertools.combinations(sorted({i[0] for i in basket}), 2))
    assert {(r.a, r.b): r.joint_count for r in counted.collect()} == want
    tails = B._tails(baskets).withColumn("n", F.lit(1).cast("bigint"))
    dealt = B.count_tails(tails, B.item_counts(baskets).withColumnRenamed("basket_count", "n"), 4, hot=7)
    assert {(r.a, r.b): r.joint_count for r in dealt.collect()} == want


def test_counters_and_limits_come_from_one_count(spark, monkeypatch):
    calls, whole = [], B.evidence
    monkeypatch.setattr(B, "evidence", lambda *given: calls.append(1) or whole(*given))
    rows = entry.queries()["source_limit_warnings"](spark, "/root/testdata/sf0.001").count()
    assert rows > 0 and calls == [1]


def test_baskets_of_orders_need_one_shuffle_of_the_lines(spark):
    from wicker.plans import views as V

    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        contents = B.basket_contents(V.basket_items(spark, "/root/testdata/sf0.001"), V.WINDOW)
        plan = B.gather(contents).arrays._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert plan.count("Exchange hashpartitioning") == 2  # lines and orders
