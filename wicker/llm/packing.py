"""Best-fit packing of documents into fixed-length sequences (operator 3).

Every document is encoded and closed with an end id. A longer one than the
capacity is cut into full pieces, the first of which takes the remainder. Pieces
are placed by best-fit decreasing: longest first, each into the open sequence
with the least room that still holds it.

Pieces of one length are interchangeable, so the plan needs only how many there
are of each length: at most `capacity` numbers, whatever the size of the corpus.
`plan` runs best-fit decreasing over them. Sequences with the same room are held
as one class, a segment tree over the remaining capacities finds the tightest
class in logarithmic time, and a run of equal pieces is placed in one step. The
result is that of placing the pieces of the whole corpus one by one. A piece then
finds its place from its length and its number among the pieces of that length;
numbers come from counts per written part and prefix sums, so no length is
sorted or gathered in one task.

Defined cases: NULL and empty texts are one end id; repeated rows are packed each
on their own; an empty table gives no rows; NULL document ids stay NULL; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wicker.llm.encode import text_batches, worker_encoder
from wicker.session import stage_table

PIECES = "doc_id long, piece int, start long, length long, ids binary, part long, number long"
EVENTS = "length long, first long, last long, base long, per long, place long"


class TightestRoom:
    """Segment tree over remaining capacities: which hold an open class, and the least one not under a bound."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << (capacity + 1).bit_length()
        self.open = np.zeros(2 * self.size, np.int64)

    def add(self, room: int, change: int) -> None:
        at = room + self.size
        while at:
            self.open[at] += change
            at >>= 1

    def find(self, least: int) -> int | None:
        """The smallest room >= least with an open class."""
        at = least + self.size
        if self.open[at]:
            return least
        while at > 1 and (at & 1 or not self.open[at + 1]):
            at >>= 1
        if at <= 1:
            return None
        at += 1
        while at < self.size:
            at *= 2
            at += not self.open[at]
        return int(at - self.size)


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing over counts by length.

    Returns events (length, first, last, base, per, place) and the number of
    sequences: pieces numbered first..last-1 of a length fill the sequences from
    base on, `per` in each, the first at offset place.
    """
    tree = TightestRoom(capacity)
    classes: dict[int, list[tuple[int, int]]] = {}  # room: [(base, how many sequences)]
    events, sequences = [], 0

    def give(room: int, base: int, many: int) -> None:
        if many and room:
            classes.setdefault(room, []).append((base, many))
            tree.add(room, 1)

    for length in sorted(counts, reverse=True):
        done, count = 0, counts[length]
        while done < count:
            room = tree.find(length)
            if room is None:  # all the rest opens new sequences, as full as this length makes them
                per = capacity // length
                room, base, many = capacity, sequences, -(-(count - done) // per)
                sequences += many
            else:
                base, many = classes[room].pop()
                tree.add(room, -1)
                per = room // length
            full = min(many, (count - done) // per)
            if full:
                events.append((length, done, done + full * per, base, per, capacity - room))
                done += full * per
                give(room - per * length, base, full)
            if full < many:
                rest = count - done  # fewer than one sequence takes
                if rest:
                    events.append((length, done, count, base + full, rest, capacity - room))
                    give(room - rest * length, base + full, 1)
                    done, full = count, full + 1
                give(room, base + full, many - full)
    return events, sequences


def encode_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0
) -> DataFrame:
    """Pieces of all documents, written to the shared folder: ids as little-endian unsigned 32-bit, numbered per part and length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder, seen = worker_encoder(tokenizer), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            at = 0
            for texts in text_batches(batch.column("text"), 4 << 20):
                ids, ends = encoder.with_end(texts, end_id)
                sizes = np.diff(ends)
                many = -(-sizes // capacity)
                head = sizes - (many - 1) * capacity
                of = np.repeat(np.arange(len(sizes)), many)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
                length = np.where(piece == 0, head[of], capacity)
                start = np.where(piece == 0, 0, head[of] + (piece - 1) * capacity)
                order = np.argsort(length, kind="stable")
                ranked = length[order]
                new = np.flatnonzero(np.diff(ranked, prepend=-1))
                number = np.empty(len(of), np.int64)
                number[order] = np.arange(len(of)) - np.repeat(new, np.diff(np.append(new, len(of)))) + seen[ranked]
                seen += np.bincount(length, minlength=capacity + 1)
                bounds = np.append(0, np.cumsum(length) * 4).astype(np.int32)
                flat = pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(bounds), pa.py_buffer(ids.astype("<u4"))])
                doc = batch.column("doc").slice(at, len(texts)).take(pa.array(of))
                at += len(texts)
                columns = [doc, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), flat]
                columns += [pa.array(np.full(len(of), part), pa.int64()), pa.array(number, pa.int64())]
                whole = pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids", "part", "number"])
                for k in range(0, len(of), 2000):
                    yield whole.slice(k, 2000)

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return stage_table(rows.mapInArrow(cut, PIECES), "pieces", compression="zstd")


def place(pieces: DataFrame, capacity: int = 2048, counts: DataFrame | None = None) -> DataFrame:
    """Adds sequence_id and offset to pieces with part, number and length, and drops part and number.

    `counts` (part, length, pieces) may be given where it is already stored.
    """
    spark = pieces.sparkSession
    if counts is None:
        counts = stage_table(pieces.groupBy("part", "length").agg(F.count("*").alias("pieces")), "piece_counts")
    by_length = {r.length: r.pieces for r in counts.groupBy("length").agg(F.sum("pieces").alias("pieces")).collect()}
    events, _ = plan(by_length, capacity)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("pieces").over(earlier), F.lit(0)).alias("before"))
    numbered = pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("number") + F.col("before"))
    # for each length the firsts and what belongs to them, ascending: a row a length, so at most `capacity` rows
    by: dict[int, list[tuple]] = {}
    for e in events:
        by.setdefault(e[0], []).append(e[1:])
    rows = [(k, [e[0] for e in v], [[e[0], e[2], e[3], e[4]] for e in v]) for k, v in by.items()]
    table = spark.createDataFrame(rows, "length long, firsts array<long>, steps array<array<long>>")
    steps = table.select("length", F.posexplode("firsts").alias("k", "first"), "steps").select(
        "length", "first", F.lead("first", 1, 1 << 62).over(Window.partitionBy("length").orderBy("first")).alias("next"), F.col("steps")[F.col("k")].alias("step")
    )
    # full pieces and other runs of one event join without a search; the table's size depends on the capacity alone
    placed = numbered.join(
        F.broadcast(steps), (numbered["length"] == steps["length"]) & (numbered["rank"] >= steps["first"]) & (numbered["rank"] < steps["next"])
    )
    within = F.col("rank") - F.col("step")[0]
    keep = [numbered[c] for c in pieces.columns if c not in ("part", "number")]
    return placed.select(
        *keep,
        (F.col("step")[1] + F.floor(within / F.col("step")[2])).cast("long").alias("sequence_id"),
        (F.col("step")[3] + (within % F.col("step")[2]) * numbered["length"]).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """All pieces with their ids and place: doc_id, piece, start, length, ids, sequence_id, offset."""
    return place(encode_pieces(docs, tokenizer, capacity, id_col, text_col, end_id), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence with its pieces in order; a sequence holds at most `capacity` ids."""
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("tokens"),
        F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids"))).alias("pieces"),
    )
