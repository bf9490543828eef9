"""Exact histogram of encoded lengths (operator 9).

Documents are encoded in batches and aggregated by encoded length; suffix sums
over the lengths then answer, for every context limit at once, how many documents
and ids exceed it, what a cut at the limit keeps, and which quantile it is. The
sums run in two levels, within blocks of lengths and over block totals, so no
task holds all lengths.

Defined cases: NULL and empty texts have length 0; repeated rows count each;
an empty table gives an empty histogram; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wicker.llm.encode import text_batches, worker_encoder

BLOCK = 1024


def length_counts(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """(length, docs) with one row per encoded length that occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer)
        for batch in batches:
            found = [np.diff(encoder.encode(texts)[1]) for texts in text_batches(batch.column(0))]
            if found:
                length, docs_of = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(length, pa.int64()), pa.array(docs_of, pa.int64())], ["length", "docs"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "length long, docs long")
    return rows.groupBy("length").agg(F.sum("docs").alias("docs"))


def length_histogram(counts: DataFrame) -> DataFrame:
    """Per length L: docs, docs_upto (length <= L), docs_over and tokens_over (length > L), tokens_cut
    (ids kept when every document is cut at L), share_upto (docs_upto of all documents), tokens_all, docs_all."""
    block = F.floor(F.col("length") / BLOCK)
    rows = counts.select("length", "docs", (F.col("length") * F.col("docs")).alias("tokens"), block.alias("block"))
    totals = rows.groupBy("block").agg(F.sum("docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    # one row per 1024 lengths
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    later = totals.select(
        "block",
        F.coalesce(F.sum("block_docs").over(after), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("block_tokens").over(after), F.lit(0)).alias("later_tokens"),
        F.sum("block_docs").over(everything).alias("docs_all"),
        F.sum("block_tokens").over(everything).alias("tokens_all"),
    )
    longer = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.select(
        "*",
        F.coalesce(F.sum("docs").over(longer), F.lit(0)).alias("own_docs"),
        F.coalesce(F.sum("tokens").over(longer), F.lit(0)).alias("own_tokens"),
    ).join(later, "block")
    over = F.col("own_docs") + F.col("later_docs")
    tokens_over = F.col("own_tokens") + F.col("later_tokens")
    return summed.select(
        "length",
        "docs",
        (F.col("docs_all") - over).alias("docs_upto"),
        over.alias("docs_over"),
        tokens_over.alias("tokens_over"),
        (F.col("tokens_all") - tokens_over + over * F.col("length")).alias("tokens_cut"),
        ((F.col("docs_all") - over) / F.col("docs_all")).alias("share_upto"),
        "docs_all",
        "tokens_all",
    )


def quantile_length(histogram: DataFrame, share: float) -> DataFrame:
    """The least length that at least `share` of the documents do not exceed."""
    return histogram.where(F.col("share_upto") >= share).agg(F.min("length").alias("length"))
