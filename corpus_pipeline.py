"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before
it kept; run() writes its result as Parquet to the shared folder and reads it back
for the next. All but the last return the columns they were given.

quality        fits the passage model on labelled documents, drops what scores under 0.3
near_dup       keeps one document of each near-duplicate class, the one with the least id
decontaminate  drops documents that hold a benchmark item
secrets        scans each distinct text once and masks what is found; no document goes
pack           packs the texts into sequences of at most 2048 ids
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wicker.llm import decontaminate, near_dup, quality, secret_scan
from wicker.llm.encode import default_tokenizer
from wicker.llm.packing import encode_pieces, place
from wicker.session import drop_folders, folders_made, new_folder, stage_table

KEEP_FROM = 0.3
CAPACITY = 2048


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that score under KEEP_FROM; labels of a fifth of the ids are held out of the fit."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    known = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    model = quality.train(docs, known)
    kept = tuple(c for c in docs.columns if c != "doc_id")
    scored = quality.score_quality(docs, model, keep=kept, score_col="__score")
    return scored.where(F.col("__score") >= KEEP_FROM).select(*docs.columns)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each class: the least id, NULL last."""
    return near_dup.one_of_each(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), decontaminate.LeakParams(short_items=True))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets; n_chars follows the text."""
    found = secret_scan.scan_secrets(docs, new_folder(spark, "secret_ledger"), keep=tuple(docs.columns), spans_col="__spans")
    hit = F.size("__spans") > 0
    clean = found.withColumn("text", F.when(hit, secret_scan.masked(F.col("text"), F.col("__spans"))).otherwise(F.col("text")))
    return clean.withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their place in the packed sequences; a digest stands for the ids."""
    pieces = encode_pieces(docs, default_tokenizer(), CAPACITY)
    return place(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), CAPACITY)


STAGES = [
    ("quality", quality_stage),
    ("near_dup", near_dup_stage),
    ("decontaminate", decontaminate_stage),
    ("secrets", secrets_stage),
    ("pack", pack_stage),
]

# a fitted model, sketches and a tokenizer are not SQL; tests/llm compares the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = folders_made()
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name)
        drop_folders(spark, since)  # what the stage worked with, and the result of the one before
    return STAGES[-1][1](spark, docs, sf_dir)
