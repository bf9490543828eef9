import pytest
from pyspark.sql import functions as F

CLASHES = ("doc ids key bands sketch size bucket component spans blob blobs todo score passages label w t1 t2 start n place code window "
           "shard part number length block rank piece sequence_id offset item_id class_id __text").split()  # fmt: skip


@pytest.fixture
def docs_of(spark):
    """A documents table from (doc_id, text) rows, with NULL columns whose names the operators use inside."""

    def make(rows):
        df = spark.createDataFrame([(i, t, None, None, None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        return df.withColumns({c: F.lit(None).cast("string") for c in CLASHES})

    return make


LONG = "alpha beta gamma. " * 12000
ODD = [(5, "some text, here.\n\nAnd more"), (None, "no id"), (None, None), (3, None), (2, ""), (7, " \n\t "), (9, "x"), (9, "x"), (9, "y"), (1, LONG), (11, "ünï — 日本語 ½")]


@pytest.fixture
def odd_rows():
    """NULLs, empty and blank texts, repeated rows and ids, a long text, other scripts."""
    return ODD
