import pathlib

import corpus_pipeline
import __spark_entry__ as entry
from pyspark.sql import functions as F

from wicker.session import scratch_root

SF = "/root/testdata/sf0.001"


def test_queries_are_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))


def test_stages_take_odd_rows(spark, docs_of, odd_rows):
    """Every stage keeps the columns and, where it drops none, all rows of a table with NULLs, repeats and clashing names."""
    docs = docs_of(odd_rows)
    clean = len({t or "" for _, t in odd_rows})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        if name == "near_dup":
            assert out.count() == clean
        elif name != "quality":
            assert out.count() == len(odd_rows)
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).select("doc_id").distinct().count() == len({i for i, _ in odd_rows})


def test_decisions_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SF).cache()
        assert kept.dtypes == docs.dtypes
        ids = {r.doc_id for r in kept.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()}
        if name == "secrets":
            assert kept.where(F.col("text").rlike("[0-9a-f]{24}")).count() == 0
            assert len(ids) == before.count()
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").distinct().collect()} == ids


def test_a_run_leaves_the_last_result_only(spark):
    root = pathlib.Path(scratch_root(spark))
    before = set(root.glob("wicker-*"))
    rows = corpus_pipeline.run(spark, SF)
    left = {p.name for folder in set(root.glob("wicker-*")) - before for p in folder.iterdir()}
    assert "secrets" in left and not left & {"quality", "near_dup", "decontaminate", "sketches", "shingle_sets", "windows", "secret_ledger"}
    assert rows.count() > 0
