"""Spelling variants of words within one edit, by PartEnum signatures (operator 11).

A word is a binary vector with one dimension for each number of occurrences of each
letter. One inserted or deleted letter changes one dimension, a replaced one two. The
letters are dealt into three parts: vectors at a distance of at most two agree in all
dimensions of at least one part, so equal projections on some part find every pair.

Letters alone tell words of common syllables badly apart, so a signature joins the
projection with what one edit must leave in place: the word is cut in `segments`, the
edit lies in one of them, and the others are equal, counted from the start before it
and from the end after it. A longer word is cut as if it were one letter shorter, which
is how it meets its shorter partner. Signatures are joined by equality and each pair is
verified by its edit distance inside the join, so no unverified pair is written.

The form of a word is its most frequent near word, if that is frequent enough; roots
follow forms. The frequency grows by at least the `times` along a chain, so chains are
short, and each round of joins halves what is left of them.

Defined cases: NULL text has no words; a NULL id counts as an empty one in the noise
hash; repeated rows count twice; letters are code points, so texts and words of any
length count whole; ties go to the smaller word in code-point order; an empty table
gives no rows; columns other than id and text are not read. A signature shared by very
many words is split by Spark's skew join, one side of it at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wicker.llm.words import U, _power, mix
from wicker.session import stage_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = 3  # a distance of two leaves at least one of three parts alone


@dataclass(frozen=True)
class SpellingParams:
    """letters: class of a word's characters. noise: of how many runs one loses a letter, 0 for none. times: how much more frequent a form is."""

    letters: str = r"[A-Za-zÀ-ÿ]"
    least_length: int = 7
    least_count: int = 2
    noise: int = 0
    times: int = 10
    segments: int = 3


def words_of_texts(docs: DataFrame, p: SpellingParams, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all texts: lower-cased runs of letters, with their number of occurrences."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(f"({p.letters}{{{p.least_length},}})"))
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("__id"), F.explode(found).alias("__run"))
    runs = runs.select("__id", F.translate("__run", UPPER, LOWER).alias("word"))
    if p.noise:
        h = F.crc32(F.concat("__id", F.lit(":"), "word").cast("binary"))
        size = F.length("word")
        at = (h % size).cast("int")
        cut = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, size))
        runs = runs.select(F.when(h % p.noise == 0, cut).otherwise(F.col("word")).alias("word"))
        runs = runs.where(F.length("word") >= p.least_length)
    return runs.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= p.least_count)


def signatures_of(words: list[str], segments: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit signatures (words x kinds), and for each kind whether the word stands as the shorter of a pair, or as of equal length."""
    n = len(words)
    code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(U)
    size = np.fromiter(map(len, words), np.int64, n)
    ends = np.append(0, np.cumsum(size))
    letter = mix(code * U(0x9E3779B97F4A7C15) + U(1))
    up, down = _power(len(code) + 1)
    total = np.append(U(0), np.cumsum(letter * up[: len(code)], dtype=U))
    part = (letter >> U(7)) % U(PARTS)
    projections = []
    for k in range(PARTS):  # sums over the letters of the part: equal multisets have equal sums
        sums = np.append(U(0), np.cumsum(np.where(part == k, mix(letter), U(0)), dtype=U))
        projections.append(mix((sums[ends[1:]] - sums[ends[:-1]]) * U(2) + U(k)))
    out, short = [], []
    for longer in (0, 1):
        common = np.maximum(size - longer, 0)
        for s in range(segments):
            a, b = common * s // segments, common * (s + 1) // segments
            head = (total[ends[:-1] + a] - total[ends[:-1]]) * down[ends[:-1]]
            begin = ends[1:] - (common - b)
            tail = (total[ends[1:]] - total[begin]) * down[begin]
            left = mix(mix(mix(head) + tail) + common.astype(U) * U(segments) + U(s))
            for projection in projections:
                out.append(mix(left ^ projection))
                short.append(not longer)
    return np.stack(out, axis=1).view(np.int64) if out else np.zeros((n, 0), np.int64), np.array(short)


def signatures(words: DataFrame, p: SpellingParams) -> DataFrame:
    """(signature, short, word, n) for every signature of every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 10_000):
                part = batch.slice(at, 10_000)
                marks, short = signatures_of(part.column("word").to_pylist(), p.segments)
                kinds = len(short)
                take = pa.array(np.repeat(np.arange(part.num_rows), kinds))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(marks.ravel()), pa.array(np.tile(short, part.num_rows)), part.column("word").take(take), part.column("n").take(take)],
                    ["signature", "short", "word", "n"],
                )

    return words.select("word", "n").mapInArrow(run, "signature long, short boolean, word string, n long")


def near_pairs(words: DataFrame, p: SpellingParams) -> DataFrame:
    """(word, n, near, near_n): every pair of words at edit distance one, once."""
    marks = signatures(words, p)
    a = marks.select("signature", "short", "word", "n").alias("a")
    b = marks.select("signature", "short", "word", "n").alias("b")
    met = a.join(
        b,
        (F.col("a.signature") == F.col("b.signature"))
        & F.col("a.short")
        & (~F.col("b.short") | (F.col("a.word") < F.col("b.word")))
        & (F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1),
    )
    return met.select(F.col("a.word").alias("word"), F.col("a.n").alias("n"), F.col("b.word").alias("near"), F.col("b.n").alias("near_n")).distinct()


def spelling_variants(words: DataFrame, params: SpellingParams | None = None) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every word of (word, n), where words are distinct."""
    p = params or SpellingParams()
    words = stage_table(words.select("word", "n"), "words")
    pairs = near_pairs(words, p)
    both = pairs.select(F.explode(F.array(F.struct("word", F.col("near").alias("other"), F.col("near_n").alias("other_n")), F.struct(F.col("near").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n")))).alias("e")).select("e.*")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), best).withColumn("near_n", -F.col("best.less"))
    frequent = F.col("near_n") >= p.times * F.col("n")
    known = words.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(frequent, F.col("best.other")).alias("form"),
        F.when(frequent, F.col("near_n")).alias("form_n"),
    )
    known = stage_table(known, "forms")
    roots = known.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:  # each round doubles the steps that a root is away
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = stage_table(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = roots.where("moved").limit(1).count()
        roots = roots.select("word", "root")
        if not moved:
            break
    return known.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
