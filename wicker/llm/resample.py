"""Importance resampling towards a target by hashed n-grams (operator 12).

Words and their runs of one to `longest` words are features, hashed to buckets by
CRC-32. A bucket's gain compares its share in the target with its share in the corpus,
both smoothed by one; a document's weight is the sum over its features. With Gumbel
noise from a hash of the id, the documents of highest score are a draw without
replacement in proportion to exp(weight / 1000).

Arrow kernels do the work on slices of the text column: ascii_lower,
split_pattern_regex, list_flatten and dictionary_encode give word numbers; numbers
shifted by one word are joined to numbers of n-grams; each distinct n-gram of a slice
is hashed once, and its bucket or gain is taken by number. Only bucket counts leave
the tasks of the first pass, at most `buckets` a slice; the driver holds one gain a
bucket. Ranks come from a range partitioning by score: the place in the partition plus
the sizes of those before it, so no task sorts the whole.

Defined cases: NULL text has no words; a document without features has weight 0;
texts of any length are read whole, a slice holds at least one text; ties go to the
smaller id, NULL first; a NULL id is hashed as an empty one; repeated rows are scored
and ranked each; an empty table gives no rows, an empty target gives gains from the
smoothing alone; columns other than id and text are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wicker.llm.encode import text_batches
from wicker.session import stage_table

SLICE_BYTES = 4 << 20
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # after lower-casing: all of ASCII but digits and letters


@dataclass(frozen=True)
class ResampleParams:
    """longest: words of the longest n-gram. percent: share of the documents with at least least_words words that is drawn."""

    longest: int = 1
    buckets: int = 10_000
    percent: int = 10
    least_words: int = 20
    seed: str = "2024"


@dataclass
class Grams:
    """Features of a slice: for each length the distinct n-grams, and the number of each occurrence and its text."""

    distinct: list[pa.Array]
    number: list[np.ndarray]
    text: list[np.ndarray]
    words: np.ndarray


def grams(column: pa.Array, longest: int) -> Grams:
    """All runs of 1 to `longest` words of a slice from text_batches."""
    texts = len(column)
    parts = pc.split_pattern_regex(pc.ascii_lower(column), BETWEEN_WORDS)
    word, text = pc.list_flatten(parts), pc.list_parent_indices(parts)
    some = pc.not_equal(word, "")
    coded = word.filter(some).dictionary_encode()
    text = text.filter(some).to_numpy().astype(np.int64)
    single = coded.indices.to_numpy().astype(np.int64)
    out = Grams([coded.dictionary], [single], [text], np.bincount(text, minlength=texts))
    strings, starts, n, base = coded.dictionary, np.arange(len(single)), len(single), len(coded.dictionary) + 1
    for k in range(1, longest):
        here = np.flatnonzero(text[: max(0, n - k)] == text[k:])  # a run does not leave its text
        before = out.number[-1][np.searchsorted(starts, here)]
        pair, number = np.unique(before * base + single[here + k], return_inverse=True)
        strings = pc.binary_join_element_wise(strings.take(pa.array(pair // base)), coded.dictionary.take(pa.array(pair % base)), pa.scalar(" ", strings.type))
        starts = here
        out.distinct.append(strings)
        out.number.append(number)
        out.text.append(text[here])
    return out


def buckets_of(distinct: pa.Array, buckets: int) -> np.ndarray:
    crc = zlib.crc32
    data = distinct.cast(pa.large_binary()).to_pylist()
    return np.fromiter((crc(x) for x in data), np.int64, len(data)) % buckets


def bucket_counts(docs: DataFrame, p: ResampleParams, text_col: str = "text") -> DataFrame:
    """(bucket, features): how many features of all texts fall in each bucket; buckets without any are not listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(p.buckets, np.int64)
        for batch in batches:
            for texts in text_batches(batch.column(0), SLICE_BYTES):
                found = grams(texts, p.longest)
                for distinct, number in zip(found.distinct, found.number):
                    times = np.bincount(number, minlength=len(distinct))
                    np.add.at(total, buckets_of(distinct, p.buckets), times)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "features"])

    counted = docs.select(F.col(text_col)).mapInArrow(run, "bucket long, features long")
    return counted.groupBy("bucket").agg(F.sum("features").alias("features"))


def gains(corpus: DataFrame, target: DataFrame, p: ResampleParams) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares by bucket, rounded down; the frames are counts by bucket."""
    both = corpus.select("bucket", F.col("features").alias("s"), F.lit(0).cast("long").alias("t"))
    both = both.unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("features").alias("t")))
    s, t = [0] * p.buckets, [0] * p.buckets
    for row in both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect():  # at most `buckets` rows
        s[row["bucket"]], t[row["bucket"]] = row["s"], row["t"]
    all_s, all_t = float(sum(s) + p.buckets), float(sum(t) + p.buckets)
    return np.array([math.floor(1000 * math.log((y + 1) * all_s / ((x + 1) * all_t))) for x, y in zip(s, t)], np.int64)


def gumbel(id_col: str, seed: str) -> Column:
    """Thousandths of Gumbel noise, rounded down, from the first 32 bits of a digest of the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def weigh(docs: DataFrame, gain: np.ndarray, p: ResampleParams, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in text_batches(batch.column("text"), SLICE_BYTES):
                n = len(texts)
                found = grams(texts, p.longest)
                features, weight = np.zeros(n, np.int64), np.zeros(n, np.int64)
                for distinct, number, text in zip(found.distinct, found.number, found.text):
                    each = gain.take(buckets_of(distinct, p.buckets)).take(number)
                    size = np.bincount(text, minlength=n)
                    features += size
                    some = np.flatnonzero(size)
                    if len(some):
                        weight[some] += np.add.reduceat(each, np.searchsorted(text, some))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, n), *map(pa.array, (found.words, features, weight))], ["doc_id", "n_words", "n_features", "weight"])
                at += n

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    weighed = rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")
    return weighed.withColumn("score", F.col("weight") + gumbel("doc_id", p.seed))


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """Adds rank, from 1 in the given order, without bringing all rows to one task."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # ids grow by one within a partition, and the partition's number is above the lower 33 bits
    placed = placed.withColumn("__id", F.monotonically_increasing_id())
    placed = placed.withColumns({"__part": F.shiftright("__id", 33), "__place": F.col("__id").bitwiseAND((1 << 33) - 1)})
    placed = stage_table(placed.drop("__id"), "ranges")
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__size"))  # one row a partition
    before = F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    return placed.join(sizes, "__part").withColumn("rank", F.col("__before") + F.col("__place") + 1).drop("__part", "__place", "__before")


def resample(docs: DataFrame, target: DataFrame, params: ResampleParams | None = None, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank): rank is NULL where a row is not drawn."""
    p = params or ResampleParams()
    gain = gains(bucket_counts(docs, p, text_col), bucket_counts(target, p, target_text_col), p)
    scored = stage_table(weigh(docs, gain, p, id_col, text_col), "scores")
    able = F.col("n_words") >= p.least_words
    draw = scored.where(able).count() * p.percent // 100
    order = ranked(scored.where(able), F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    drawn = order.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    return drawn.unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")))
