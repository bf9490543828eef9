"""Snapshots as immutable Parquet folders, with a pointer to the active one.

Edges are filed in folders by a hash of their source (`bucket`), and each bucket has
a digest of its own. A lookup reads the buckets of the sources it asks for, and two
snapshots are compared bucket by bucket, reading only those whose digests differ.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wicker.operators import snapshot as S
from wicker.operators.sequence import snapshot_diff
from wicker.operators.validate import SOURCE

# folders of a snapshot: enough that one holds what a task reads with ease
BUCKETS = 64

EDGES = (
    "source_product_id string, source_combination_id string, target_product_id string, target_combination_id string, "
    "relationship_type string, evidence_kind string, joint_count bigint, source_count bigint, target_count bigint, "
    "total_transactions bigint, support double, confidence double, lift double, transition_count bigint, "
    "transition_probability double, median_lag_days double, rule_id string, rule_version string, reliability double, "
    "window_from timestamp, window_to timestamp, model_version string"
)


class SnapshotError(RuntimeError):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def _exists(spark: SparkSession, path: str) -> bool:
    fs, jvm = _fs(spark, path)
    return fs.exists(jvm.org.apache.hadoop.fs.Path(path))


def _rename(spark: SparkSession, source: str, target: str) -> bool:
    """Move a folder; False where the target is there already, so that two writers cannot end up inside each other."""
    fs, jvm = _fs(spark, target)
    path = jvm.org.apache.hadoop.fs.Path
    fs.mkdirs(path(target).getParent())
    at = fs.makeQualified(path(target))
    none = jvm.java.lang.reflect.Array.newInstance(jvm.org.apache.hadoop.fs.Options.Rename.NONE.getClass(), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(
            fs.makeQualified(path(source)), at, none
        )
    except Py4JJavaError as error:
        if _exists(spark, target):
            return False
        raise SnapshotError("SNAPSHOT_WRITE_FAILURE", f"cannot move {source} to {target}") from error
    return True


def _write_text(spark: SparkSession, path: str, content: str) -> None:
    """Replace a small file: write beside it, then rename over it."""
    fs, jvm = _fs(spark, path)
    hadoop_path = jvm.org.apache.hadoop.fs.Path
    beside = hadoop_path(f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(beside, True)
    stream.write(bytearray(content.encode()))
    stream.close()
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(
        fs.makeQualified(beside), fs.makeQualified(hadoop_path(path)), _overwrite(jvm)
    )


def _drop(spark: SparkSession, path: str) -> None:
    fs, jvm = _fs(spark, path)
    fs.delete(jvm.org.apache.hadoop.fs.Path(path), True)


def _overwrite(jvm):
    option = jvm.org.apache.hadoop.fs.Options.Rename
    options = jvm.java.lang.reflect.Array.newInstance(option.OVERWRITE.getClass(), 1)
    jvm.java.lang.reflect.Array.set(options, 0, option.OVERWRITE)
    return options


def _read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(path).collect())


def _folder(root: str, snapshot_id: str) -> str:
    return f"{root}/snapshots/{snapshot_id.replace(':', '-')}"


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*SOURCE), F.lit(buckets)).cast("int").alias("bucket")


def _stage(edges: DataFrame, root: str, buckets: int) -> tuple[str, DataFrame]:
    """Compute the edges once, into a folder of their own, in snapshot order inside each bucket."""
    beside = f"{root}/incoming/{uuid.uuid4().hex}"
    names = [f.split()[0] for f in EDGES.split(",")]
    typed = edges.select(*[F.col(n).cast(f.split()[1]).alias(n) for n, f in zip(names, EDGES.split(","))])
    filed = typed.withColumn("bucket", bucket_of(buckets)).repartition("bucket").sortWithinPartitions("bucket", *S.canonical_keys())
    filed.write.partitionBy("bucket").parquet(f"{beside}/edges")
    return beside, _edges(edges.sparkSession, beside)


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(f"{EDGES}, bucket int").parquet(f"{folder}/edges")


def _keep(beside: str, staged: DataFrame, root: str, buckets: int) -> tuple[str, str]:
    """Move staged edges to their id. An id that is taken must hold the same content, by a hash of another kind."""
    spark = staged.sparkSession
    meta = {**S.digest(staged).first().asDict(), "second_sum": S.second_sum(staged), "buckets": buckets}
    snapshot_id = meta["snapshot_id"]
    folder = _folder(root, snapshot_id)
    if not _exists(spark, folder):
        _write_text(spark, f"{beside}/meta.json", json.dumps(meta))
        S.bucket_digests(staged).coalesce(1).write.parquet(f"{beside}/digests")  # one row a bucket
        if _rename(spark, beside, folder):
            return snapshot_id, "created"
    if read_meta(spark, root, snapshot_id)["second_sum"] != meta["second_sum"]:
        raise SnapshotError("SNAPSHOT_ID_COLLISION", f"other content under {snapshot_id}")
    return snapshot_id, "already_exists"


def write_snapshot(edges: DataFrame, root: str, buckets: int = BUCKETS) -> tuple[str, str]:
    """Store a snapshot under its content id; returns (id, created | already_exists)."""
    beside, staged = _stage(edges, root, buckets)
    try:
        return _keep(beside, staged, root, buckets)
    finally:
        _drop(edges.sparkSession, beside)


def read_snapshot(spark: SparkSession, root: str, snapshot_id: str | None = None) -> DataFrame | None:
    """Edges of one snapshot, or of the active one; None when nothing is active."""
    filed = _read_filed(spark, root, snapshot_id)
    return None if filed is None else filed.drop("bucket")


def _read_filed(spark: SparkSession, root: str, snapshot_id: str | None) -> DataFrame | None:
    dangling = snapshot_id is None
    if snapshot_id is None:
        snapshot_id = active_id(spark, root)
        if snapshot_id is None:
            return None
    folder = _folder(root, snapshot_id)
    if not _exists(spark, folder):
        if dangling:
            raise SnapshotError("SNAPSHOT_NOT_FOUND", f"active snapshot {snapshot_id} does not exist")
        return None
    return _edges(spark, folder)


def read_for(spark: SparkSession, root: str, requests: DataFrame, snapshot_id: str | None = None) -> DataFrame | None:
    """Edges of the buckets that the requests' sources are filed in; other folders are not read."""
    snapshot_id = snapshot_id or active_id(spark, root)
    filed = None if snapshot_id is None else _read_filed(spark, root, snapshot_id)
    if filed is None:
        return None
    asked = requests.select(bucket_of(read_meta(spark, root, snapshot_id)["buckets"])).distinct()
    wanted = sorted(r["bucket"] for r in asked.collect())  # at most one number a bucket
    return filed.filter(F.col("bucket").isin(wanted)).drop("bucket")


def changed_buckets(spark: SparkSession, root: str, old: str, new: str) -> list[int] | None:
    """Buckets whose edges differ between two snapshots; None where the two are filed differently."""
    if read_meta(spark, root, old)["buckets"] != read_meta(spark, root, new)["buckets"]:
        return None
    sides = [spark.read.parquet(f"{_folder(root, i)}/digests") for i in (old, new)]
    # a bucket with equal digests occurs twice; one row a bucket and snapshot reaches the driver at most
    once = sides[0].unionByName(sides[1]).groupBy(*sides[0].columns).agg(F.count(F.lit(1)).alias("n")).filter("n = 1")
    return sorted(r["bucket"] for r in once.select("bucket").distinct().collect())


def diff(spark: SparkSession, root: str, old: str, new: str) -> DataFrame:
    """Edges, by identity, that only one of two stored snapshots has; buckets with equal digests are not read."""
    for i in (old, new):
        if not _exists(spark, _folder(root, i)):
            raise SnapshotError("SNAPSHOT_NOT_FOUND", f"cannot compare unknown snapshot {i}")
    changed = changed_buckets(spark, root, old, new)
    sides = [_read_filed(spark, root, i) for i in (old, new)]
    if changed is not None:
        sides = [s.filter(F.col("bucket").isin(changed)) for s in sides]
    return snapshot_diff(*[s.drop("bucket") for s in sides])


def metadata(spark: SparkSession, root: str, snapshot_id: str) -> DataFrame:
    """The declared metadata of a stored snapshot as one row."""
    names = ["snapshot_id", "schema_version", "model_version", "window_from", "window_to"]
    meta = read_meta(spark, root, snapshot_id)
    row = (*[meta[n] for n in names], meta["relationship_count"])
    return spark.createDataFrame([row], ", ".join(f"{n} string" for n in names) + ", relationship_count bigint")


def read_meta(spark: SparkSession, root: str, snapshot_id: str) -> dict:
    return json.loads(_read_text(spark, f"{_folder(root, snapshot_id)}/meta.json"))


def active_id(spark: SparkSession, root: str) -> str | None:
    path = f"{root}/active.json"
    if not _exists(spark, path):
        return None
    try:
        return json.loads(_read_text(spark, path))["snapshot_id"]
    except (ValueError, KeyError) as error:
        raise SnapshotError("INVALID_SNAPSHOT", "active pointer cannot be read") from error


def activate(spark: SparkSession, root: str, snapshot_id: str) -> None:
    """Point to a stored snapshot; also the way back to an earlier one."""
    if not _exists(spark, _folder(root, snapshot_id)):
        raise SnapshotError("SNAPSHOT_NOT_FOUND", f"cannot activate unknown snapshot {snapshot_id}")
    _write_text(spark, f"{root}/active.json", json.dumps({"snapshot_id": snapshot_id}))


def publish(
    edges: DataFrame,
    root: str,
    allow_empty: bool = False,
    empty_meta: dict | None = None,
    model_version: str | None = None,
    buckets: int = BUCKETS,
) -> dict:
    """Check, store, then activate. The pointer moves last, and only on success.

    `model_version` is the one that was validated; edges of another stop the publication.
    """
    beside, staged = _stage(edges, root, buckets)
    try:
        return _publish(beside, staged, root, allow_empty, empty_meta, model_version, buckets)
    finally:
        _drop(edges.sparkSession, beside)


def _publish(
    beside: str, staged: DataFrame, root: str, allow_empty: bool, empty_meta: dict | None, model_version: str | None, buckets: int
) -> dict:
    spark = staged.sparkSession
    stats = S.snapshot_stats(staged).first().asDict()
    warnings = []
    if stats["relationships_read"] == 0:
        if not allow_empty:
            raise SnapshotError("EMPTY_SNAPSHOT_NOT_ALLOWED", "no edges to publish")
        if empty_meta is None:
            raise SnapshotError("EMPTY_SNAPSHOT_METADATA_REQUIRED", "an empty snapshot needs its own metadata")
        if not all(str(empty_meta.get(k) or "").strip() for k in ("model_version", "window_from", "window_to")):
            raise SnapshotError("INVALID_EMPTY_SNAPSHOT_METADATA", "model version and window are needed")
        warnings.append("EMPTY_SNAPSHOT_PUBLISHED")
    else:
        broken = S.publish_checks(staged, None if model_version is None else F.lit(model_version)).filter(F.col("violations") > 0).collect()  # at most four rows
        if broken:
            raise SnapshotError(broken[0]["check"], f"{broken[0]['violations']} violations")
    snapshot_id, status = _keep(beside, staged, root, buckets)
    activate(spark, root, snapshot_id)
    return {"snapshot_id": snapshot_id, "status": status, "warnings": warnings, **stats}
