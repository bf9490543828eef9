"""Near-duplicate classes of documents by DartMinHash (operator 7).

Similarity is the weighted Jaccard similarity of five-word shingles, each
weighted by how often it occurs in the text. Texts are linked from `threshold`
on, and a class is a connected component of links; equal texts are one class.

1. Every text is sketched (`darts`); the sketch is cut into bands, and texts that
   agree in a band share a bucket. Equal texts are folded into one beforehand.
2. Each bucket has a hub, the member with the most company over all its buckets,
   and every member is paired with it: pairs grow with the members, not their
   square. Pairs are checked exactly on their shingles and linked.
3. Buckets whose members are by then not in one class are compared inside, block
   by block and between different classes only: pairs whose sketches allow the
   threshold are checked exactly, likeliest first, until the classes they belong
   to are joined. What leaves a block is at most one link for each class in it.
   So each pair that shares a bucket ends in one class or was found too different.

Pairs are dropped unchecked only if their sizes forbid the threshold, or if their
sketches agree in so few entries that the threshold lies over four standard
deviations away.

Defined cases: NULL text counts as empty; empty texts are equal to each other;
texts without words are alike only if equal; repeated rows are one class; rows
with a NULL id get the class id of their text's class, which is NULL only if no
row of the class has an id; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wicker.llm.components import components
from wicker.llm.darts import bands, sketch
from wicker.llm.encode import text_batches
from wicker.llm.words import U, counted, mix, shingles_of, words_of
from wicker.session import stage_table

# a slice of texts worked on at once: its shingles grow with the bytes, its darts with the number of texts
SLICE_BYTES = 2 << 20
SLICE_TEXTS = 512


@dataclass(frozen=True)
class NearDupParams:
    """threshold: least similarity of a link. bands x rows: entries of a sketch. block, block_shingles: members compared in one go."""

    threshold: float = 0.8
    shingle: int = 5
    bands: int = 20
    rows: int = 5
    block: int = 1024
    block_shingles: int = 1 << 20

    @property
    def plausible(self) -> float:
        """Share of equal entries below which a pair cannot be expected to reach the threshold."""
        p, k = self.threshold, self.bands * self.rows
        return p - 4 * math.sqrt(p * (1 - p) / k)


def text_key(text: str) -> Column:
    """Digest of a text; NULL counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def sketches(docs: DataFrame, p: NearDupParams, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, size, bands, sketch) for every row; key is a digest of the text, size its number of shingles."""
    count, rows = p.bands, p.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in text_batches(batch.column("text"), SLICE_BYTES, SLICE_TEXTS):
                n = len(texts)
                code, text = shingles_of(words_of(texts), p.shingle)
                size = np.bincount(text, minlength=n)
                entries = sketch(*counted(code, text), n, count * rows)
                cut = bands(entries, count, rows)
                has = size > 0
                ends = np.append(0, np.cumsum(has * count)).astype(np.int32)
                band = pa.ListArray.from_arrays(pa.array(ends), pa.array(cut[has].view(np.int64).ravel()))
                short = (entries & U(0xFFFF)).astype("<u2")
                small = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * count * rows * 2).astype(np.int32)), pa.py_buffer(short)])
                own = [batch.column(c).slice(at, n) for c in ("doc_id", "key")]
                at += n
                yield pa.RecordBatch.from_arrays([*own, pa.array(size, pa.int64()), band, small], ["doc_id", "key", "size", "bands", "sketch"])

    rows_in = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("key"), F.col(text_col).alias("text"))
    return rows_in.mapInArrow(run, "doc_id long, key binary, size long, bands array<long>, sketch binary")


def shingle_sets(docs: DataFrame, keys: DataFrame, p: NearDupParams, text_col: str) -> DataFrame:
    """(key, codes) of the texts in `keys`: sorted 64-bit codes, the n-th occurrence of a shingle having its own code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in text_batches(batch.column("text"), SLICE_BYTES, SLICE_TEXTS):
                n = len(texts)
                code, text, times = counted(*shingles_of(words_of(texts), p.shingle))
                nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                code, text = mix(np.repeat(code, times) + nth.astype(U) * U(0xA0761D6478BD642F)), np.repeat(text, times)
                order = np.lexsort((code, text))
                size = np.bincount(text, minlength=n)
                ends = np.append(0, np.cumsum(size) * 8).astype(np.int32)
                codes = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(code[order].astype("<u8"))])
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(at, n), codes], ["key", "codes"])
                at += n

    # copies meet on the map side before they are dealt out, so a large group of them sends one row per task; an inner join
    # with the distinct keys stays above that, where a semi join would be pushed below
    texts = docs.select(text_key(text_col).alias("key"), F.col(text_col).alias("text")).groupBy("key").agg(F.first("text").alias("text"))
    return texts.join(keys, "key").select("key", "text").mapInArrow(run, "key binary, codes binary")


def linked(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose exact weighted similarity reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, pair in enumerate(zip(batch.column("ca"), batch.column("cb"))):
                keep[i] = similar(*(np.frombuffer(v.as_buffer(), "<u8") for v in pair), threshold)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    left, right = sets.select(F.col("key").alias("a"), F.col("codes").alias("ca")), sets.select(F.col("key").alias("b"), F.col("codes").alias("cb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ca", "cb").mapInArrow(run, "a binary, b binary")


def hub_pairs(members: DataFrame, p: NearDupParams) -> DataFrame:
    """Distinct pairs of each bucket's members with its hub."""
    company = members.groupBy("key").agg(F.sum(F.col("members") - 1).alias("company"))
    ranked = members.join(company, "key")
    hubs = ranked.groupBy("bucket").agg(F.max(F.struct("company", "key", "size")).alias("hub"))
    met = members.select("bucket", "key", "size").join(hubs, "bucket").where(F.col("key") != F.col("hub.key"))
    fits = F.least("size", "hub.size") >= p.threshold * F.greatest("size", "hub.size")
    return met.where(fits).select(F.least("key", "hub.key").alias("a"), F.greatest("key", "hub.key").alias("b")).distinct()


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether two sorted code sets reach the threshold."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or len(a) < threshold * len(b):
        return False
    at = np.searchsorted(b, a)
    same = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return same >= threshold * (len(a) + len(b) - same)


class _Joined:
    """Union-find over small numbers."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        self.up[self.find(x)] = self.find(y)


def open_links(members: DataFrame, texts: DataFrame, sets: DataFrame, labels: DataFrame, p: NearDupParams) -> DataFrame:
    """Links between classes inside the buckets that hold several: enough of them to join all that are linked there.

    The members of such a bucket meet in blocks. Plausible pairs between different
    classes are checked exactly, likeliest first, unless their classes have been
    joined by then; a pair that shares several buckets is checked in the first.
    """
    own = members.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    mixed = own.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("bucket")
    rows = own.join(mixed, "bucket", "left_semi")
    blocks = F.greatest(F.ceil(F.col("members") / p.block), F.ceil(F.col("shingles") / p.block_shingles))
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("key"), blocks))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("bucket", "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key", "size", "component")
    rows = rows.join(texts.select("key", "sketch"), "key").join(sets, "key")
    grouped = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    threshold, plausible, count, depth = p.threshold, p.plausible, p.bands, p.rows

    def compare(group: pa.Table) -> list[tuple[int, int]]:
        n = group.num_rows
        size, block = group["size"].to_numpy(), group["block"].to_numpy()
        entries = np.frombuffer(b"".join(group["sketch"].to_pylist()), "<u2").reshape(n, count * depth)
        kinds = group["component"].combine_chunks().dictionary_encode().indices.to_numpy()
        i, j, band = (group[c][0].as_py() for c in ("i", "j", "band"))
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        found = []
        for at in range(0, len(left), 64):
            x = left[at : at + 64]
            fits = np.minimum.outer(size[x], size[right]) >= threshold * np.maximum.outer(size[x], size[right])
            fits &= kinds[x][:, None] != kinds[right][None, :]
            if i == j:
                fits &= x[:, None] < right[None, :]
            u, v = np.nonzero(fits)
            for k in range(0, len(u), 20_000):
                a, b = x[u[k : k + 20_000]], right[v[k : k + 20_000]]
                equal = entries[a] == entries[b]
                near = equal.mean(axis=1)
                ok = np.flatnonzero(near >= plausible)
                first = equal[ok].reshape(-1, count, depth).all(axis=2).argmax(axis=1)
                ok = ok[first == band]
                found.append((a[ok], b[ok], near[ok]))
        if not found:
            return []
        a, b, near = (np.concatenate(z) for z in zip(*found))
        order = np.argsort(-near, kind="stable")
        codes = [np.frombuffer(v.as_buffer(), "<u8") for chunk in group["codes"].chunks for v in chunk]
        classes, links = _Joined(int(kinds.max()) + 1), []
        for x, y in zip(a[order].tolist(), b[order].tolist()):
            one, two = classes.find(kinds[x]), classes.find(kinds[y])
            if one != two and similar(codes[x], codes[y], threshold):
                classes.join(one, two)
                links.append((x, y))
        return links

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(group: pa.Table) -> Iterator[pa.RecordBatch]:
            links = compare(group)
            if links:
                keys = group["key"].combine_chunks()
                yield pa.RecordBatch.from_arrays([keys.take(pa.array([x[k] for x in links])) for k in (0, 1)], ["a", "b"])

        held: list[pa.Table] = []
        last = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            ids = [part[c].to_numpy() for c in ("bucket", "i", "j")]
            cut = np.flatnonzero(np.any([np.diff(c) != 0 for c in ids], axis=0)) + 1
            bounds = [0, *cut.tolist(), part.num_rows]
            for s, e in zip(bounds, bounds[1:]):
                if s == e:
                    continue
                name = tuple(int(c[s]) for c in ids)
                if name != last and held:
                    yield from found(pa.concat_tables(held))
                    held = []
                held.append(part.slice(s, e - s))
                last = name
        if held:
            yield from found(pa.concat_tables(held))

    return grouped.mapInArrow(run, "a binary, b binary")


def text_classes(docs: DataFrame, p: NearDupParams, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The sketches of all rows, and (key, least_id, copies, component) of all distinct texts."""
    every = stage_table(sketches(docs, p, id_col, text_col), "sketches")
    texts = every.groupBy("key").agg(
        F.min("doc_id").alias("least_id"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")
    )
    texts = stage_table(texts, "texts")
    placed = texts.select("key", "size", F.posexplode("bands").alias("band", "bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("members"), F.sum("size").alias("shingles")).where("members > 1")
    members = stage_table(placed.join(shared, "bucket"), "members")
    sets = stage_table(shingle_sets(docs, members.select("key").distinct(), p, text_col), "shingle_sets")
    first = components(stage_table(linked(hub_pairs(members, p), sets, p.threshold), "links"))
    more = stage_table(open_links(members, texts, sets, first, p), "links")
    # links of the second kind join whole classes of the first
    of = [first.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in ("a", "b")]
    joined = more.join(of[0], "a", "left").join(of[1], "b", "left")
    joined = joined.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    second = components(joined)
    own = texts.select("key", "least_id", "copies").join(first.toDF("key", "c1"), "key", "left").withColumn("c1", F.coalesce("c1", "key"))
    own = own.join(second.toDF("c1", "c2"), "c1", "left").select("key", "least_id", "copies", F.coalesce("c2", "c1").alias("component"))
    return every, stage_table(own, "text_classes")


def near_duplicates(docs: DataFrame, params: NearDupParams | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, class_rows, class_key, key): every row with the least id of its class and the rows of the class.

    class_key tells classes apart where ids are NULL; key is the digest of the row's text.
    """
    every, own = text_classes(docs, params or NearDupParams(), id_col, text_col)
    classes = own.groupBy("component").agg(F.min("least_id").alias("class_id"), F.sum("copies").alias("class_rows"))
    by_text = own.join(classes, "component").select("key", "class_id", "class_rows", F.col("component").alias("class_key"))
    return every.select("doc_id", "key").join(by_text, "key").select("doc_id", "class_id", "class_rows", "class_key", "key")


def one_of_each(docs: DataFrame, params: NearDupParams | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, with the columns it came with: the least id, NULL last; of texts that repeat it, the least digest."""
    every, own = text_classes(docs, params or NearDupParams(), id_col, text_col)
    # a large group of copies is one row here: rows are not joined to their class, only the chosen ids and texts to the rows
    rank = F.struct(F.col("least_id").isNull().alias("none"), "least_id", "key")
    chosen = own.groupBy("component").agg(F.min_by(F.struct("least_id", "key"), rank).alias("best")).select("best.*")
    chosen = stage_table(chosen.toDF("__id", "__key"), "chosen")
    same = lambda key, id_: (key == F.col("__key")) & id_.eqNullSafe(F.col("__id"))
    kept = docs.join(chosen, same(text_key(text_col), F.col(id_col).cast("long")))
    repeated = every.join(chosen, same(every["key"], every["doc_id"])).groupBy("__key").agg(F.count("*").alias("rows")).where("rows > 1")
    if repeated.limit(1).count():  # rows that repeat id and text: one of them stays
        row = Window.partitionBy("__key").orderBy(*[docs[c].cast("string") for c in docs.columns if c != text_col])
        kept = kept.withColumn("__row", F.row_number().over(row)).where("__row = 1")
    return kept.select(*[docs[c] for c in docs.columns])
