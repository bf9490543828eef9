"""Token ids in flat binary files (operator 2).

A corpus is a folder with one shard per range of document ids. Shard `s` has
three flat little-endian files: `s.ids` (all token ids, unsigned 16-bit where
the vocabulary allows, else unsigned 32-bit), `s.offsets` (unsigned 64-bit, one
more than documents, counted from the start of the shard) and `s.docs` (signed
64-bit document ids). `manifest.json` lists the shards in order with the number
of documents and ids before each: prefix sums over the shard totals, so that the
position of any document in the whole corpus is base + offset.

Tasks write under a name of their own and rename when complete, so a retried or
speculative task leaves one whole file. Readers map the files into memory.

Defined cases: NULL text counts as empty (only the end id); rows with a NULL
document id come first; repeated ids are ordered by a hash of the text, then by
the text, and all stay; an empty table gives a manifest without shards; other
columns are not read.
"""

from __future__ import annotations

import io
import json
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wicker.llm.encode import Encoder, text_batches, worker_encoder

SHARD = "shard int, docs long, tokens long, null_ids long"


@dataclass(frozen=True)
class Corpus:
    """What a reader needs to know of a written corpus."""

    path: str
    id_bytes: int
    shards: list[dict]


def shared_uri(spark: SparkSession, path: str) -> str:
    """A path as a full URI of the file system that the cluster takes it for."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = str(at.getFileSystem(conf).makeQualified(at).toString())
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def open_fs(uri: str):
    """The file system of a URI and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _put(store, path: str, own: str, body: bytes) -> None:
    with store.open_output_stream(own) as out:
        out.write(body)
    store.move(own, path)


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    shards: int | None = None,
) -> Corpus:
    """Encode all texts and write them in ascending order of document id.

    `path` is a folder that driver and executors share. `shards` defaults to the
    shuffle partitions of the session.
    """
    spark = docs.sparkSession
    uri = shared_uri(spark, path)
    store, folder = open_fs(uri)
    store.create_dir(folder, recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    if shards is None:
        shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_bytes = 2 if max(Encoder(tokenizer).vocabulary, end_id + 1) <= 1 << 16 else 4
    kind = np.dtype(f"<u{id_bytes}")
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(shards, "doc", tie).sortWithinPartitions("doc", tie, "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder, at, offsets, ids, nulls = worker_encoder(tokenizer), 0, [np.zeros(1, "<u8")], [], 0
        own_store, own_folder = open_fs(uri)
        name = f"{own_folder}/{part:06d}"
        own = f"{own_folder}/.{part:06d}-{uuid.uuid4().hex}"
        out = None
        for batch in batches:
            doc = batch.column("doc")
            nulls += doc.null_count
            ids.append(doc.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
            for texts in text_batches(batch.column("text")):
                if out is None:
                    out = own_store.open_output_stream(own)
                found, ends = encoder.with_end(texts, end_id)
                out.write(found.astype(kind).tobytes())
                offsets.append((at + ends[1:]).astype("<u8"))
                at += int(ends[-1])
        if out is None:
            return
        out.close()
        own_store.move(own, f"{name}.ids")
        _put(own_store, f"{name}.offsets", own, np.concatenate(offsets).tobytes())
        _put(own_store, f"{name}.docs", own, np.concatenate(ids).tobytes())
        total = sum(len(x) for x in ids)
        yield pa.RecordBatch.from_pydict(
            {
                "shard": pa.array([part], pa.int32()),
                "docs": pa.array([total], pa.int64()),
                "tokens": pa.array([at], pa.int64()),
                "null_ids": pa.array([nulls], pa.int64()),
            }
        )

    # one row a shard comes back, however many documents there are
    totals = sorted(tuple(r) for r in ordered.mapInArrow(write, SHARD).collect())
    shard_rows, docs_before, ids_before = [], 0, 0
    for shard, count, tokens, nulls in totals:
        shard_rows.append(
            {"shard": shard, "docs": count, "tokens": tokens, "null_ids": nulls, "docs_before": docs_before, "ids_before": ids_before}
        )
        docs_before, ids_before = docs_before + count, ids_before + tokens
    corpus = Corpus(uri, id_bytes, shard_rows)
    _put(store, f"{folder}/manifest.json", f"{folder}/.manifest-{uuid.uuid4().hex}", json.dumps(asdict(corpus)).encode())
    return corpus


def open_corpus(spark: SparkSession, path: str) -> Corpus:
    """The manifest of a corpus."""
    store, folder = open_fs(shared_uri(spark, path))
    with store.open_input_stream(f"{folder}/manifest.json") as f:
        return Corpus(**json.loads(f.read()))


def map_file(uri: str, name: str, kind: str) -> np.ndarray:
    """A flat file as an array: mapped where the file system is local, else read."""
    store, folder = open_fs(uri)
    at = f"{folder}/{name}"
    if store.type_name == "local":
        return np.memmap(at, dtype=kind, mode="r") if os.path.getsize(at) else np.zeros(0, kind)
    with store.open_input_file(at) as f:
        return np.frombuffer(io.BytesIO(f.read()).getbuffer(), dtype=kind)


def read_documents(spark: SparkSession, corpus: Corpus, with_ids: bool = False) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32, and `ids` where asked for.

    `start` counts the ids of all documents before; `ids_crc32` is over the ids
    as little-endian unsigned 32-bit integers.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    if not corpus.shards:
        return spark.createDataFrame([], schema)
    uri, kind = corpus.path, f"<u{corpus.id_bytes}"
    rows = [(s["shard"], s["ids_before"], s["null_ids"]) for s in corpus.shards]
    shards = spark.createDataFrame(rows, "shard int, ids_before long, null_ids long").repartition(len(rows), "shard")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{row['shard']:06d}"
                ids, ends, docs = (map_file(uri, f"{name}.{x}", k) for x, k in (("ids", kind), ("offsets", "<u8"), ("docs", "<i8")))
                ends = np.asarray(ends, np.int64)
                for at in range(0, len(docs), 1000):
                    to = min(at + 1000, len(docs))
                    own = [np.asarray(ids[ends[i] : ends[i + 1]]) for i in range(at, to)]
                    empty = np.arange(at, to) < row["null_ids"]
                    columns = [
                        pa.array(np.asarray(docs[at:to]), pa.int64(), mask=empty),
                        pa.array(row["ids_before"] + ends[at:to], pa.int64()),
                        pa.array(np.diff(ends[at : to + 1]), pa.int64()),
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in own], pa.int64()),
                    ]
                    if with_ids:
                        columns.append(pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return shards.mapInArrow(read, schema)
