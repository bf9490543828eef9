import shutil

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from wicker.operators import lookup as L
from wicker.operators import snapshot as S
from wicker.operators import validate as C
from wicker.plans.build_job import BuildConfig, BuildError, build_snapshot
from wicker.params import PairParams
from wicker.sources import store

FROM, TO = "2025-01-01 00:00:00", "2025-12-31 00:00:00"


def edge(s, t, reliability=0.5, kind="same_order", **over):
    row = dict(
        source_product_id=s, source_combination_id=None, target_product_id=t, target_combination_id=None,
        relationship_type=kind, evidence_kind="co_occurrence", joint_count=2, source_count=4, target_count=4,
        total_transactions=10, support=0.2, confidence=0.5, lift=0.5 / 0.4, transition_count=None,
        transition_probability=None, median_lag_days=None, rule_id=None, rule_version=None, reliability=reliability,
        window_from=FROM, window_to=TO, model_version="m1", seq=0,
    )
    return {**row, **over}


SCHEMA = """source_product_id string, source_combination_id string, target_product_id string, target_combination_id string,
 relationship_type string, evidence_kind string, joint_count bigint, source_count bigint, target_count bigint,
 total_transactions bigint, support double, confidence double, lift double, transition_count bigint,
 transition_probability double, median_lag_days double, rule_id string, rule_version string, reliability double,
 window_from string, window_to string, model_version string, seq bigint"""


def frame(spark, *edges):
    names = [c.strip().split(" ")[0] for c in SCHEMA.split(",")]
    df = spark.createDataFrame([tuple(e[n] for n in names) for e in edges], SCHEMA)
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ("window_from", "window_to")})


def test_validation_codes(spark):
    cases = {
        "INVALID_SOURCE_PRODUCT": edge(" ", "B"),
        "SELF_RELATIONSHIP": edge("A", "A"),
        "UNSUPPORTED_RELATIONSHIP_TYPE": edge("A", "C", kind="other"),
        "EVIDENCE_TYPE_MISMATCH": edge("A", "D", kind="manual"),
        "INVALID_EVIDENCE_WINDOW": edge("A", "E", window_from=TO, window_to=FROM),
        "INVALID_RELIABILITY": edge("A", "F", reliability=1.1),
        "INVALID_JOINT_COUNT": edge("A", "G", joint_count=0),
        "INVALID_EVIDENCE_COUNTS": edge("A", "H", source_count=0),
        "INCONSISTENT_EVIDENCE_COUNTS": edge("A", "I", joint_count=5),
        "INCONSISTENT_LIFT": edge("A", "J", lift=1.3),
        "NON_POSITIVE_ASSOCIATION": edge("A", "K", target_count=5, lift=1.0),
        "RELIABILITY_BELOW_MINIMUM": edge("A", "L", reliability=0.1),
        "NON_SERIALIZABLE_RELATIONSHIP": edge("A", "M", support=float("nan")),
    }
    df = frame(spark, *[{**e, "seq": i} for i, e in enumerate(cases.values())])
    got = {r.seq: r.reject_code for r in C.validate(df).collect()}
    assert got == dict(enumerate(cases))


def test_repeat_of_an_accepted_edge_is_rejected(spark):
    low = edge("A", "B", reliability=0.1, seq=1)
    df = frame(spark, low, edge("A", "B", seq=2), edge("A", "B", seq=3))
    got = {r.seq: r.reject_code for r in C.validate(df).collect()}
    assert got == {1: "RELIABILITY_BELOW_MINIMUM", 2: None, 3: "DUPLICATE_RELATIONSHIP"}
    assert C.warnings(C.validate(df)).first().code == "PARTIAL_VALIDATION_SUCCESS"
    assert C.warnings(C.validate(df.limit(0))).first().code == "EMPTY_INPUT"


def test_digest_ignores_order_and_sees_content(spark):
    a, b = edge("A", "B"), edge("B", "A")
    first = S.digest(frame(spark, a, b)).first().snapshot_id
    assert first == S.digest(frame(spark, b, a).repartition(3)).first().snapshot_id
    assert first != S.digest(frame(spark, a, {**b, "reliability": 0.6})).first().snapshot_id
    assert first != S.digest(frame(spark, a, a)).first().snapshot_id


def test_store_lifecycle(spark, tmp_path):
    root = str(tmp_path)
    assert store.read_snapshot(spark, root) is None
    one, two = frame(spark, edge("A", "B")), frame(spark, edge("A", "B"), edge("A", "C"))
    first = store.publish(one, root)
    assert store.write_snapshot(one, root) == (first["snapshot_id"], "already_exists")
    second = store.publish(two, root)
    assert store.read_snapshot(spark, root).count() == 2
    store.activate(spark, root, first["snapshot_id"])
    assert store.read_snapshot(spark, root).count() == 1
    assert store.read_snapshot(spark, root, second["snapshot_id"]).count() == 2
    assert store.read_meta(spark, root, second["snapshot_id"])["relationship_count"] == 2
    with pytest.raises(store.SnapshotError, match="SNAPSHOT_NOT_FOUND"):
        store.activate(spark, root, "sha256:none")
    with pytest.raises(store.SnapshotError, match="DUPLICATE_VALIDATED_RELATIONSHIP"):
        store.publish(frame(spark, edge("A", "B"), edge("A", "B")), root)
    with pytest.raises(store.SnapshotError, match="EMPTY_SNAPSHOT_NOT_ALLOWED"):
        store.publish(one.limit(0), root)
    assert store.active_id(spark, root) == first["snapshot_id"]
    meta = {"model_version": "m1", "window_from": FROM, "window_to": TO}
    assert store.publish(one.limit(0), root, True, meta)["warnings"] == ["EMPTY_SNAPSHOT_PUBLISHED"]


def test_lookup_limits_and_unknown_sources(spark):
    edges = frame(spark, edge("A", "C"), edge("A", "B"), edge("A", "B", kind="same_cart"))
    requests = spark.createDataFrame(
        [(1, "A", None, None, None), (2, "A", None, ["same_order"], 1), (3, "Z", None, None, 5)],
        "request_id int, source_product_id string, source_combination_id string, relationship_types array<string>, limit int",
    )
    got = L.find_by_source(requests, edges.drop("seq"))
    listed = [(r.request_id, r.position, r.target_product_id, r.total_matched, r.returned) for r in got.collect()]
    assert sorted(listed, key=repr) == sorted(
        [(1, 1, "B", 3, 3), (1, 2, "B", 3, 3), (1, 3, "C", 3, 3), (2, 1, "B", 2, 1), (3, None, None, 0, 0)], key=repr
    )


ROWS = [(1, 29), (1, 30), (2, 29), (2, 30), (3, 29), (3, 31), (4, 32), (4, 30), (5, 33), (5, 34)]


def test_build_job_end_to_end(spark, tmp_path):
    orders = spark.createDataFrame([(str(i), "5") for i in range(1, 6)], "order_id string, order_state string")
    orders = orders.withColumn("occurred_at", F.lit("2025-02-01 00:00:00").cast("timestamp"))
    lines = spark.createDataFrame(
        [(str(o), n, str(p), 1.0) for n, (o, p) in enumerate(ROWS)],
        "order_id string, line_id int, product_id string, quantity double",
    )
    cfg = BuildConfig(str(tmp_path), FROM, ("5",), max_products=3, pairs=PairParams(max_per_source=20))
    done = build_snapshot(orders, lines, cfg)
    assert done["orders_accepted"] == 5 and done["pair_candidates"] == 8 and done["valid_relationships"] == 2
    kept = store.read_snapshot(spark, str(tmp_path)).collect()
    assert {(r.source_product_id, r.target_product_id) for r in kept} == {("29", "30"), ("30", "29")}
    assert all(r.support == 0.4 and r.confidence == 2 / 3 and r.joint_count == 2 for r in kept)
    with pytest.raises(BuildError):
        build_snapshot(orders, lines, BuildConfig(str(tmp_path), FROM, ("5",), min_reliability=1.0))
    assert store.active_id(spark, str(tmp_path)) == done["snapshot_id"]


def test_different_content_has_different_ids(spark):
    def id_of(*edges):
        return S.digest(frame(spark, *edges)).first().snapshot_id

    assert id_of(edge("A", "B", lift=1e8)) != id_of(edge("A", "B", lift=5e8))
    assert id_of(edge("1|x", "y")) != id_of(edge("1", "x|y"))
    assert id_of(edge("A", "B")) != id_of(edge("A", "B", source_combination_id="~"))
    assert id_of(edge("A", "B", source_combination_id="-")) != id_of(edge("A", "B"))


def test_collision_is_found(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "edge_fingerprint", lambda: F.sha2(F.lit("same").cast("binary"), 256))
    assert store.write_snapshot(frame(spark, edge("A", "B")), str(tmp_path))[1] == "created"
    assert store.write_snapshot(frame(spark, edge("A", "B")), str(tmp_path))[1] == "already_exists"
    with pytest.raises(store.SnapshotError, match="SNAPSHOT_ID_COLLISION"):
        store.write_snapshot(frame(spark, edge("A", "C")), str(tmp_path))
    assert list((tmp_path / "incoming").glob("*/*")) == []


def test_other_version_stops_a_publication(spark, tmp_path):
    with pytest.raises(store.SnapshotError, match="MODEL_VERSION_MISMATCH"):
        store.publish(frame(spark, edge("A", "B")), str(tmp_path), model_version="m2")
    assert list((tmp_path / "incoming").iterdir()) == [] and store.active_id(spark, str(tmp_path)) is None


def test_lookups_read_the_buckets_of_their_sources(spark, tmp_path):
    root = str(tmp_path)
    edges = frame(spark, *[edge(f"S{i}", f"T{k}", reliability=0.3 + k / 10) for i in range(200) for k in range(3)])
    store.publish(edges, root, buckets=16)
    one = spark.createDataFrame([(1, "S7", None, None, None)], "request_id int, source_product_id string, source_combination_id string, relationship_types array<string>, limit int")
    read = store.read_for(spark, root, one)
    files = lambda df: df.select(F.input_file_name()).distinct().count()
    assert files(read) == 1 and files(store.read_snapshot(spark, root)) == 16
    many = one.withColumn("source_product_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(199)), lambda n: F.concat(F.lit("S"), n.cast("string")))))
    assert files(store.read_for(spark, root, many)) == 16
    found = L.find_by_source(one, read).collect()
    assert [(r["target_product_id"], r["position"], r["total_matched"]) for r in found] == [("T0", 1, 3), ("T1", 2, 3), ("T2", 3, 3)]
    none = one.filter("request_id > 1")
    assert store.read_for(spark, root, none).count() == 0
    assert store.read_for(spark, f"{root}/other", one) is None


def test_diff_reads_only_changed_buckets(spark, tmp_path):
    root = str(tmp_path)
    rows = [edge(f"S{i}", "T") for i in range(200)]
    old, _ = store.write_snapshot(frame(spark, *rows), root, buckets=16)
    rows[7] = edge("S7", "U")
    new, _ = store.write_snapshot(frame(spark, *rows), root, buckets=16)
    assert len(store.changed_buckets(spark, root, old, new)) == 1
    for snapshot in (old, new):  # what has not changed can be gone
        for folder in (tmp_path / "snapshots" / snapshot.replace(":", "-") / "edges").glob("bucket=*"):
            if folder.name != f"bucket={store.changed_buckets(spark, root, old, new)[0]}":
                shutil.rmtree(folder)
    found = store.diff(spark, root, old, new)
    assert sorted((r["source_product_id"], r["target_product_id"], r["change"]) for r in found.collect()) == [("S7", "T", "vanished"), ("S7", "U", "appeared")]
    assert len(set(found.columns)) == len(found.columns)
    assert store.changed_buckets(spark, root, old, old) == [] and store.diff(spark, root, old, old).count() == 0
    more, _ = store.write_snapshot(frame(spark, *rows, edge("Z", "Y")), root, buckets=16)
    other, _ = store.write_snapshot(frame(spark, *rows[:100]), root, buckets=4)
    assert store.changed_buckets(spark, root, more, other) is None
    assert store.diff(spark, root, more, other).filter("change = 'vanished'").count() == 101
    with pytest.raises(store.SnapshotError):
        store.diff(spark, root, old, "sha256:none")


def test_evidence_that_changes_is_no_change_of_identity(spark, tmp_path):
    old, _ = store.write_snapshot(frame(spark, edge("A", "B")), str(tmp_path))
    new, _ = store.write_snapshot(frame(spark, edge("A", "B", reliability=0.9)), str(tmp_path))
    assert store.changed_buckets(spark, str(tmp_path), old, new) and store.diff(spark, str(tmp_path), old, new).count() == 0


def test_subtotals_of_validation(spark):
    rows = frame(spark, edge("A", "B"), edge("A", "C", kind="manual", window_from="2025-02-01 00:00:00"), edge("A", "D", model_version=None))
    judged = rows.withColumn("reject_code", F.when(F.col("target_product_id") == "C", "X"))
    got = {(r["relationship_type"], r["model_version"], r["month"], r["level"]): (r["read"], r["accepted"], r["rejected"]) for r in C.rollup_stats(judged).collect()}
    assert got[None, None, None, 7] == (3, 2, 1)
    assert got["same_order", None, None, 3] == (2, 2, 0)
    assert got["same_order", None, None, 1] == (1, 1, 0)  # the model that is NULL, over its months
    assert got["same_order", None, "2025-01", 0] == (1, 1, 0)
    assert got["manual", "m1", "2025-02", 0] == (1, 0, 1)


def test_a_snapshot_query_mines_once(spark, monkeypatch):
    read, write = [], store.write_snapshot
    monkeypatch.setattr(store, "write_snapshot", lambda edges, root: read.extend(edges.inputFiles()) or write(edges, root))
    for name in ("snapshot_write", "snapshot_diff", "snapshot_activate"):
        entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert read and not any("testdata" in f for f in read)
