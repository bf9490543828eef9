"""Benchmark passages in documents (operator 10), by DataFrame functions only.

Texts are cut into words (letters and digits, lower case). A document window of
the size of a benchmark item is compared with it by the weighted similarity
sum(min) / sum(max) of their five-word shingles, each weighted by how often it
occurs; from `threshold` on the document holds the item.

1. A window without a shingle of an item has similarity zero to it, so windows are
   laid only where a document's shingle is one of a benchmark item: so many words
   before it as in the item.
2. Each window gets a 64-bit SimHash of its words, as each item has one. Both are
   cut into radius + 1 blocks; fingerprints within the radius agree in at least
   one block, so a join on item, block number and block value finds them all, and
   the Hamming distance then holds exactly. A window is compared with the items
   that it was laid for.
3. Candidates are verified by the exact similarity.

With `short_items`, an item with fewer words than a shingle has one shingle of all its words. A window
of its size is like it only if it holds the same words, so it is looked up among
the runs of that length; runs are laid only for lengths that such items have.

Equal texts are searched once, under two 64-bit hashes of the text, and found
items are joined back to every document. Shingles of the benchmark are broadcast
only if a count shows them under `broadcast_limit`; beyond it the join shuffles.

Defined cases: NULL and empty texts hold nothing; items without a
word match nothing, nor do items with fewer than five words unless `short_items` is
set; a document shorter than an item is compared
whole; repeated rows are each reported; NULL ids stay NULL; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wicker.session import stage_table

BITS = 64


@dataclass(frozen=True)
class LeakParams:
    """radius: Hamming distance of fingerprints that still counts as near. short_items: items with fewer words than a shingle are looked for too, else they match nothing (the registered queries set it). broadcast_limit: most benchmark shingles sent to every task."""

    threshold: float = 0.8
    shingle: int = 5
    radius: int = 20
    broadcast_limit: int = 500_000
    short_items: bool = False


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles(w: Column, size: int) -> Column:
    """Hash of the run of `size` words at every place."""
    last = F.size(w) - size
    run = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))
    return F.when(last >= 0, run).otherwise(F.array().cast("array<bigint>"))


def simhash(features: Column) -> Column:
    """64-bit fingerprint: bit b is set where more feature hashes have it set than not."""

    def vote(value: Column, b: Column) -> Column:
        return F.lit(2) * F.getbit(value, b).cast("int") - F.lit(1)

    total = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.aggregate(features, F.lit(0), lambda s, h: s + vote(h, b)))
    marks = F.transform(total, lambda s, b: F.when(s > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(marks, F.lit(0).cast("bigint"), lambda a, m: a.bitwiseOR(m))


def blocks(fingerprint: Column, radius: int) -> Column:
    """radius + 1 slices (number, value) that cover the fingerprint."""
    count = radius + 1
    edges = [BITS * k // count for k in range(count + 1)]
    return F.array(
        *[
            F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(fingerprint, low).bitwiseAND(F.lit((1 << (high - low)) - 1)).alias("value"))
            for k, (low, high) in enumerate(zip(edges, edges[1:]))
        ]
    )


def text_id(text: str) -> tuple[Column, Column]:
    value = F.coalesce(F.col(text), F.lit(""))
    return F.xxhash64(value).alias("t1"), F.xxhash64(F.lit("second"), value).alias("t2")


def item_texts(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.col(item_col).alias("item_id"), words(F.col(text_col)).alias("item_words")).distinct()


def short_leaks(text: DataFrame, benchmark: DataFrame, p: LeakParams, item_col: str, item_text_col: str) -> DataFrame | None:
    """(t1, t2, item_id, start, similarity) of the items shorter than a shingle; None if there are none. `text`: t1, t2, w."""
    short = item_texts(benchmark, item_col, item_text_col).where(F.size("item_words").between(1, p.shingle - 1)).withColumn("n", F.size("item_words"))
    # at most shingle - 1 numbers
    lengths = sorted(r.n for r in short.select("n").distinct().collect())
    if not lengths:
        return None

    def of_length(w: Column, k: int) -> Column:
        return F.transform(shingles(w, k), lambda c, i: F.struct(F.lit(k).alias("n"), c.alias("code"), i.alias("start")))

    def runs(w: Column) -> Column:
        return F.concat(*[of_length(w, k) for k in lengths])

    codes = stage_table(short.select("item_id", "n", F.inline(runs(F.col("item_words"))).alias("size", "code", "at")).where("size = n").select("item_id", "n", "code"), "short_items")
    known = F.broadcast(codes) if codes.limit(p.broadcast_limit + 1).count() <= p.broadcast_limit else codes
    found = text.select("t1", "t2", F.inline(runs(F.col("w")))).join(known, ["n", "code"])
    return found.groupBy("t1", "t2", "item_id").agg(F.min("start").alias("start")).withColumn("similarity", F.lit(1.0))


def benchmark_items(benchmark: DataFrame, p: LeakParams, item_col: str, text_col: str) -> DataFrame:
    """(item_id, item_words, n, fingerprint) of the items with at least one whole shingle; repeated items once."""
    w = item_texts(benchmark, item_col, text_col).where(F.size("item_words") >= p.shingle)
    return w.select("item_id", "item_words", F.size("item_words").alias("n"), simhash(F.transform("item_words", lambda x: F.xxhash64(x))).alias("fingerprint"))


def leaked_texts(docs: DataFrame, benchmark: DataFrame, p: LeakParams, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """(t1, t2, item_id, start, similarity): the best window of every text and item that reaches the threshold."""
    items = stage_table(benchmark_items(benchmark, p, item_col, item_text_col), "items")
    grams = items.select("item_id", "n", F.posexplode(shingles(F.col("item_words"), p.shingle)).alias("at", "code")).distinct()
    grams = stage_table(grams, "item_shingles")
    known = F.broadcast(grams) if grams.limit(p.broadcast_limit + 1).count() <= p.broadcast_limit else grams

    text = docs.select(*text_id(text_col), words(F.col(text_col)).alias("w"))
    placed = text.select("t1", "t2", F.size("w").alias("size"), F.posexplode(shingles(F.col("w"), p.shingle)).alias("place", "code"))
    start = F.least(F.greatest(F.col("place") - F.col("at"), F.lit(0)), F.greatest(F.col("size") - F.col("n"), F.lit(0)))
    # a window keeps the items that its shingle is from: it is compared with these only
    asked = stage_table(placed.join(known, "code").select("t1", "t2", "n", start.alias("start"), "item_id").distinct(), "windows")
    windows = asked.groupBy("t1", "t2").agg(F.collect_set(F.struct("n", "start")).alias("places"))

    # the words of these windows; each text is read once and cut into words once, and only windows leave it
    texts = docs.select(*text_id(text_col), F.col(text_col).alias("text")).join(windows.select("t1", "t2"), ["t1", "t2"], "left_semi")
    texts = texts.groupBy("t1", "t2").agg(F.first("text").alias("text"))
    pieces = F.transform(
        F.array(words(F.col("text"))), lambda w: F.transform("places", lambda x: F.struct(x["n"].alias("n"), x["start"].alias("start"), F.slice(w, x["start"] + 1, x["n"]).alias("window")))
    )
    cut = windows.join(texts, ["t1", "t2"]).select("t1", "t2", F.inline(F.flatten(pieces)))
    marked = stage_table(cut.withColumn("mark", simhash(F.transform("window", lambda x: F.xxhash64(x)))), "fingerprints")

    place = ["t1", "t2", "n", "start"]
    near = asked.join(marked.drop("window"), place).select(*place, "item_id", "mark", F.inline(blocks(F.col("mark"), p.radius)))
    index = items.select("item_id", "n", "fingerprint", F.inline(blocks(F.col("fingerprint"), p.radius)))
    met = near.join(index, ["item_id", "n", "block", "value"]).where(F.bit_count(F.col("mark").bitwiseXOR(F.col("fingerprint"))) <= p.radius)
    pairs = met.select(*place, "item_id").distinct()

    # shingle weights on both sides, then the shared ones
    own = pairs.join(marked.select("t1", "t2", "n", "start", "window"), ["t1", "t2", "n", "start"])
    own = own.select("t1", "t2", "start", "item_id", F.explode(shingles(F.col("window"), p.shingle)).alias("code"), (F.size("window") - p.shingle + 1).alias("total"))
    own = own.groupBy("t1", "t2", "start", "item_id", "code", "total").agg(F.count("*").alias("times"))
    theirs = items.select("item_id", (F.col("n") - p.shingle + 1).alias("item_total"), F.explode(shingles(F.col("item_words"), p.shingle)).alias("code"))
    theirs = theirs.groupBy("item_id", "item_total", "code").agg(F.count("*").alias("item_times"))
    both = own.join(theirs, ["item_id", "code"]).groupBy("t1", "t2", "start", "item_id", "total", "item_total").agg(F.sum(F.least("times", "item_times")).alias("same"))
    scored = both.withColumn("similarity", F.col("same") / (F.col("total") + F.col("item_total") - F.col("same"))).select("t1", "t2", "item_id", "start", "similarity")
    short = short_leaks(text, benchmark, p, item_col, item_text_col) if p.short_items else None
    scored = (scored if short is None else scored.unionByName(short)).where(F.col("similarity") >= p.threshold)
    best = scored.groupBy("t1", "t2", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("before"))).alias("best"))
    return best.select("t1", "t2", "item_id", (-F.col("best.before")).alias("start"), F.col("best.similarity").alias("similarity"))


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, params: LeakParams | None = None, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """(doc_id, item_id, start, similarity) for every document and the items it holds; start counts words."""
    p = params or LeakParams()
    leaks = stage_table(leaked_texts(docs, benchmark, p, text_col, item_col, item_text_col), "leaks")
    rows = docs.select(F.col(id_col).alias("doc_id"), *text_id(text_col))
    return rows.join(leaks, ["t1", "t2"]).select("doc_id", "item_id", "start", "similarity")


def without_leaks(docs: DataFrame, benchmark: DataFrame, params: LeakParams | None = None, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows whose text holds no benchmark item, with the columns they came with."""
    p = params or LeakParams()
    leaks = stage_table(leaked_texts(docs, benchmark, p, text_col, item_col, item_text_col), "leaks").select(F.col("t1").alias("__t1"), F.col("t2").alias("__t2")).distinct()
    t1, t2 = text_id(text_col)
    return docs.join(leaks, (t1 == F.col("__t1")) & (t2 == F.col("__t2")), "left_anti")
