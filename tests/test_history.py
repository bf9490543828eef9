import os
import random
import time
from collections import Counter
from datetime import datetime, timedelta
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from wicker.operators import history as H
from wicker.operators.sequence import next_purchases, successors
from wicker.operators.validity import filed, rule_edges, valid_at
from wicker.plans import load_all
from wicker.plans.registry import QUERIES
from wicker.session import stage_and_clear

ITEMS = "customer_key string, product_id string, combination_id string"


def state_of(state):
    pairs = {(r["a"], r["b"]): r["joint_count"] for r in state.pairs.collect()}
    counts = {r["item"]: r["customers"] for r in state.counts.collect()}
    return pairs, counts, state.total.first()["customers"]


def naive(lines):
    held = {}
    for customer, product, combination in lines:
        if customer is not None and product is not None:
            held.setdefault(customer, set()).add(product + ("\0" + combination if combination is not None else ""))
    pairs = Counter(p for items in held.values() for p in combinations(sorted(items), 2))
    return dict(pairs), dict(Counter(i for items in held.values() for i in items)), len(held)


def lines_of(rng, customers, products, n):
    def pick():
        return (rng.choice([None, *map(str, range(customers))]), rng.choice([None, *map(str, range(products))]), rng.choice([None, None, "1"]))

    return [pick() for _ in range(n)]


def test_pairs_against_brute_force(spark):
    lines = lines_of(random.Random(1), 12, 25, 600)
    for block in (1, 4, 64):
        assert state_of(H.build_history(spark.createDataFrame(lines, ITEMS), block)) == naive(lines)


def test_update_equals_rebuild(spark):
    rng = random.Random(2)
    old, new = lines_of(rng, 10, 20, 200), lines_of(rng, 14, 26, 150)
    new += old[:40]  # lines that are known already add nothing
    state = H.build_history(spark.createDataFrame(old, ITEMS), 4)
    state = H.update_history(state, spark.createDataFrame(new, ITEMS), 4)
    assert state_of(state) == naive(old + new)
    again = H.update_history(state, spark.createDataFrame(new, ITEMS), 4)
    assert state_of(again) == naive(old + new)
    none = H.update_history(again, spark.createDataFrame([], ITEMS), 4)
    assert state_of(none) == naive(old + new)
    edges = {(r["source_product_id"], r["source_combination_id"], r["target_product_id"], r["target_combination_id"]): r for r in H.history_evidence(none).collect()}
    pairs, counts, total = naive(old + new)
    assert len(edges) == 2 * len(pairs)
    edge = edges["1", None, "2", None]
    assert (edge["joint_count"], edge["source_count"], edge["target_count"], edge["total_transactions"]) == (pairs["1", "2"], counts["1"], counts["2"], total)
    assert edge["confidence"] == pytest.approx(pairs["1", "2"] / counts["1"])
    assert edge["lift"] == pytest.approx(pairs["1", "2"] * total / counts["1"] / counts["2"])


def test_a_customer_with_five_thousand_products(spark):
    many = spark.range(5000).select(F.lit("hot").alias("customer_key"), F.col("id").cast("string").alias("product_id"), F.lit(None).cast("string").alias("combination_id"))
    contents = H.contents_of(many.unionByName(many))
    pairs = H.pairs_within(contents)
    assert pairs.agg(F.count("*"), F.count_distinct(F.xxhash64("a", "b")), F.max(F.expr("int(a >= b)"))).first()[:] == (5000 * 4999 // 2, 5000 * 4999 // 2, 0)
    # no group of products grows with the history: a block pair holds two blocks
    _, dealt = H._in_blocks(contents, H.BLOCK, "")
    assert dealt.groupBy("own").count().agg(F.max("count")).first()[0] < 3 * H.BLOCK
    fresh = spark.createDataFrame([("hot", "new", None)], ITEMS)
    assert H.pairs_between(H.contents_of(fresh), contents).count() == 5000


def test_empty_history(spark):
    assert state_of(H.build_history(spark.createDataFrame([], ITEMS))) == ({}, {}, 0)


# -- validity ---------------------------------------------------------------

AT = datetime(2020, 1, 1)


def test_instants_in_intervals_against_brute_force(spark):
    rng = random.Random(3)
    spans = []
    for n in range(300):
        start = AT + timedelta(minutes=rng.randrange(-500_000, 500_000))
        end = start + timedelta(minutes=rng.choice([0, 1, 59, 60, 61, 600, 10_000, 400_000, -5]))
        spans.append((n, rng.choice(["a", "b", None]), rng.choice([start, start, start, None]), rng.choice([end, end, end, None])))
    spans += [(900, "a", None, None), (901, "b", datetime(1900, 1, 1), datetime(2200, 1, 1)), (902, "a", AT, AT), (903, "a", datetime(1969, 12, 31), datetime(1970, 1, 1, 1))]
    points = [(n, rng.choice(["a", "b", "c", None]), AT + timedelta(minutes=rng.randrange(-500_000, 500_000))) for n in range(200)]
    points += [(700 + n, "a", s[2] or AT) for n, s in enumerate(spans[:40])] + [(800 + n, "a", s[3] or AT) for n, s in enumerate(spans[:40])] + [(990, "a", None), (991, "a", datetime(1969, 12, 31, 12))]
    frame = spark.createDataFrame(spans, "id int, k string, valid_from timestamp, valid_to timestamp")
    asked = spark.createDataFrame(points, "n int, k string, at timestamp")
    got = sorted((r["n"], r["id"]) for r in valid_at(asked, frame, ["k"]).collect())
    want = sorted((n, i) for n, k, at in points for i, key, s, e in spans if k is not None and k == key and at is not None and (s is None or s <= at) and (e is None or at < e))
    assert got == want
    most = filed(frame, "valid_from", "valid_to").groupBy("id").count().agg(F.max("count")).first()[0]
    assert most <= 2  # also of the interval over three centuries


def test_the_join_is_by_equality(spark):
    frame = spark.createDataFrame([(1, "a", AT, None)], "id int, k string, valid_from timestamp, valid_to timestamp")
    asked = spark.createDataFrame([(1, "a", AT)], "n int, k string, at timestamp")
    plan = valid_at(asked, frame, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    none = frame.filter("id > 1")
    assert valid_at(asked, none, ["k"]).count() == 0


def test_latest_rule_wins(spark):
    day = timedelta(days=1)
    rules = [
        ("r1", "1", "a", "b", 0.5, AT, None),
        ("r2", "2", "a", "b", 0.6, AT + day, AT + 2 * day),
        ("r3", "2", "a", "b", 0.7, AT + day, AT + 2 * day),
        ("r4", "9", "a", "a", 0.7, None, None),
        (None, "9", "a", "b", 0.7, None, None),
        ("r5", "1", "a", None, 0.7, None, None),
    ]
    rules = spark.createDataFrame(rules, "rule_id string, rule_version string, source_product_id string, target_product_id string, reliability double, valid_from timestamp, valid_to timestamp")
    asked = spark.createDataFrame([(1, "a", AT), (2, "a", AT + day), (3, "a", AT + 2 * day), (4, "a", AT - day), (5, "z", AT)], "request_id int, source_product_id string, at timestamp")
    assert sorted((r["request_id"], r["rule_id"], r["relationship_type"]) for r in rule_edges(rules, asked).collect()) == [(1, "r1", "manual"), (2, "r2", "manual"), (3, "r1", "manual")]


# -- next purchases ---------------------------------------------------------


def test_next_purchases_by_hand(spark):
    rows = [("c", "t1", AT, "a"), ("c", "t2", AT + timedelta(days=3), "b"), ("c", "t2", AT + timedelta(days=3), "a"), ("c", "t3", AT + timedelta(days=10), "b"), ("d", "t9", AT, "a"), (None, "t8", AT, "a")]
    items = spark.createDataFrame([(*r, None) for r in rows], "customer_key string, transaction_id string, occurred_at timestamp, product_id string, combination_id string")
    got = {(r["source_product_id"], r["target_product_id"]): (r["transition_count"], r["source_count"], r["median_lag_days"]) for r in next_purchases(items).collect()}
    assert got == {("a", "a"): (1, 2, 3.0), ("a", "b"): (2, 2, 5.0), ("b", "b"): (1, 1, 7.0)}


def test_successors_over_ranges_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice("abc"), f"t{n:04d}", datetime(1969, 11, 1) + timedelta(hours=rng.randrange(24 * rng.choice([40, 400, 4000])))) for n in range(600)]
    rows += [("d", "only", AT), ("e", "x2", AT), ("e", "x1", AT), ("e", "x3", AT)]
    want = set()
    for customer in "abcde":
        own = sorted((at, t) for c, t, at in rows if c == customer)
        want |= {(t, n, (later.date() - at.date()).days) for (at, t), (later, n) in zip(own, own[1:])}
    got = successors(spark.createDataFrame(rows, "customer_key string, transaction_id string, at timestamp")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_a_pair_is_shuffled_as_a_list_and_counted_in_place(spark):
    lines = lines_of(random.Random(5), 40, 12, 900)
    contents = H.contents_of(spark.createDataFrame(lines, ITEMS))
    counts = H._customers(contents)
    tails = H._within(contents, 4).withColumn("n", F.lit(1).cast("bigint"))
    for hot in (3, 1000):  # with products dealt by partner and without
        found = H._counted(tails, counts, 480, hot)
        assert {(r["a"], r["b"]): r["joint_count"] for r in found.collect()} == naive(lines)[0]
    above = found._jdf.queryExecution().optimizedPlan().toString().split("Repartition")[0]
    assert "Aggregate [a" in above and "Generate explode(partners" in above  # pairs become rows after the only exchange
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(a" in plan and ", b#" not in "".join(line for line in plan.split("\n") if "Exchange hashpartitioning(a" in line)


def test_next_purchases_of_many_lags_by_brute_force(spark):
    import random
    import re
    from statistics import median

    random.seed(5)
    days, found, totals = {}, {}, {}
    for c in range(12):
        at = 0
        for n in range(9):
            days[f"{c}-{n}"] = (at, sorted(random.sample("ABCDE", 2)))
            at += random.randint(1, 40)
    for c in range(12):
        for n in range(8):
            (at, sources), (then, targets) = days[f"{c}-{n}"], days[f"{c}-{n + 1}"]
            for s in sources:
                totals[s] = totals.get(s, 0) + 1
                for t in targets:
                    found.setdefault((s, t), []).append(then - at)
    found = {k: (len(v), totals[k[0]], float(median(v))) for k, v in found.items()}
    rows = [(k, k.split("-")[0], d, p, None) for k, (d, products) in days.items() for p in products]
    items = spark.createDataFrame(rows + rows[:5], "transaction_id string, customer_key string, day int, product_id string, combination_id string")
    pairs = next_purchases(items.withColumn("occurred_at", F.expr("timestamp'2020-01-01 00:00:00' + make_interval(0, 0, 0, day)")))
    got = {(r.source_product_id, r.target_product_id): (r.transition_count, r.source_count, r.median_lag_days) for r in pairs.collect()}
    assert got == found
    # single pairs are not dealt by both products
    assert not re.search(r"hashpartitioning\((source|a)#\d+, (target|b)#", pairs._jdf.queryExecution().executedPlan().toString())


def test_pairs_are_counted_part_after_part_and_a_part_leaves_only_its_result(spark, monkeypatch):
    monkeypatch.setattr(H, "PART", 1000)
    folders = []
    monkeypatch.setattr(H, "stage_and_clear", lambda df, name: folders.append((name, staged := stage_and_clear(df, name))) or staged)
    lines = lines_of(random.Random(6), 30, 25, 700)
    pairs, _, _ = naive(lines)
    state = H.build_history(spark.createDataFrame(lines, ITEMS), 4, stored=False)
    got = H._pairs(H.in_parts(state, 2)).collect()
    assert len(got) == len({(r["a"], r["b"]) for r in got})
    assert {(r["a"], r["b"]): r["joint_count"] for r in got} == {p: n for p, n in pairs.items() if n >= 2}
    parts = [df for name, df in folders if name == "history-part"]
    assert len(parts) == sum(pairs.values()) // 1000 + 1 > 2
    firsts = [{r["a"] for r in df.collect()} for df in parts]
    assert sum(map(len, firsts)) == len(set().union(*firsts)) and max(map(len, firsts)) < len(set().union(*firsts))
    # the state that is kept has all pairs, counted in parts too
    assert state_of(H.build_history(spark.createDataFrame(lines, ITEMS), 4)) == naive(lines)


def test_a_staged_table_leaves_no_shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {x for n in range(blocks.getAllBlocks().size()) if (x := blocks.getAllBlocks().apply(n).name()).startswith("shuffle_")}
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = shuffles(), spark.conf.get(key, None)
    staged = stage_and_clear(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "sums")
    for _ in range(100):  # they go in the background
        if not (left := shuffles() - before):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(key, None) == was
    assert sorted(r["count"] for r in staged.collect()) == [142] * 1 + [143] * 6


def test_old_pairs_of_an_update_are_held_for_one_part_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(H, "PART", 1000)
    folders = []

    def spy(df, name):
        gone = [os.path.exists(f.removeprefix("file:")) for n, _, files in folders if n == "history-known" for f in files]
        staged = stage_and_clear(df, name)
        folders.append((name, gone, staged.inputFiles()))
        return staged

    monkeypatch.setattr(H, "stage_and_clear", spy)
    rng = random.Random(7)
    old, new = lines_of(rng, 25, 25, 500), lines_of(rng, 30, 28, 200)
    pairs, counts, total = naive(old + new)
    state = H.update_history(H.build_history(spark.createDataFrame(old, ITEMS), 4, stored=False), spark.createDataFrame(new, ITEMS), 4, stored=False)
    edges = H.history_evidence(state, 2).filter("target_product_id > source_product_id or target_product_id = source_product_id and target_combination_id is not null")
    assert {r["joint_count"] for r in edges.collect()} == {n for n in pairs.values() if n >= 2}
    assert H.history_evidence(state, 2).count() == 2 * sum(n >= 2 for n in pairs.values())
    assert state.total.first()[0] == total and {r["item"]: r["customers"] for r in state.counts.collect()} == counts
    known = [gone for name, gone, _ in folders if name == "history-known"]
    assert len(known) > 2 and not any(map(any, known))  # those of the former parts are gone
    # stored in parts and updated, the state is that of all lines
    assert state_of(H.update_history(H.build_history(spark.createDataFrame(old, ITEMS), 4), spark.createDataFrame(new, ITEMS), 4)) == naive(old + new)


def test_the_update_query_keeps_no_pairs_of_the_older_orders(spark, monkeypatch):
    names = []
    monkeypatch.setattr(H, "stage_and_clear", lambda df, name: names.append(name) or stage_and_clear(df, name))
    load_all()
    QUERIES["customer_history_update"](spark, "/root/testdata/sf0.001")
    assert names.count("history-part") == 1 and names.count("history-known") == 1
