"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_scratch: dict[str, str] = {}
_made = threading.local()  # folders that calls of this thread were given, in order


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("wicker")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def use_utc(spark: SparkSession) -> None:
    """All instants are UTC; parquet timestamps carry no zone."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def scratch_root(spark: SparkSession) -> str:
    """Shared folder named by the cluster; a local session may go without one.

    Executors on other machines could not read what one of them wrote to a folder
    of its own, so a cluster that names no folder is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_scratch:
        _own_scratch[app] = tempfile.mkdtemp(prefix="spark-wicker-")
        atexit.register(shutil.rmtree, _own_scratch[app], ignore_errors=True)
    return _own_scratch[app]


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder name in the shared scratch folder that no other call uses."""
    folder = f"{scratch_root(spark)}/wicker-{uuid.uuid4().hex}"
    _folders().append(folder)
    return f"{folder}/{name}"


def _folders() -> list[str]:
    if not hasattr(_made, "folders"):
        _made.folders = []
    return _made.folders


def folders_made() -> int:
    """How many folders this thread has been given so far."""
    return len(_folders())


def drop_folders(spark: SparkSession, since: int) -> None:
    """Remove the folders of this thread from number `since` on, all but the last: what a written result needs no more."""
    folders = _folders()
    jvm = spark.sparkContext._jvm
    for folder in folders[since:-1]:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    del folders[since:-1]


def stage_table(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a frame that several later jobs read, and read it back.

    Cuts the lineage through shared storage, so a lost executor costs a re-read
    and not a recomputation, and gives the planner true file sizes. Options go to
    the Parquet writer.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_and_clear(df: DataFrame, name: str) -> DataFrame:
    """`stage_table`, after which the shuffle files of the write go; else they stay until the driver happens to collect its garbage."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        return stage_table(df, name)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)
