"""Quality by attention over passages (operator 1).

A document is a bag of passages of `passage` words. Every passage of the whole
text is encoded as a vector: shares of character classes, word statistics,
repetition inside the passage and against the rest of the document, and a signed
hash of its words. Gated attention weighs the passages,

    a_k = softmax over k of  u . (tanh(V h_k) * sigmoid(G h_k)),

and a logistic layer scores the weighted vector sum(a_k h_k). Only document
labels are given; the attention learns which passages carry them.

The model is fitted on all passages of at most `sample` labelled documents, chosen by
a hash of their id, and on fewer documents if their passages are more than
`fit_total` together. Their passages are encoded by tasks; what reaches the driver
for the fit is bounded by these two. A document with labels 0 and 1 counts as 1.

Defined cases: NULL and empty texts, and texts of white space, have one passage of
zeros and get its score; repeated rows score alike; NULL ids stay NULL; an empty
table gives no rows; without labels of both kinds every document scores the share
of label 1 (0.5 without labels); other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wicker.llm.encode import flat_bytes, text_batches
from wicker.llm.words import _BACK, _BASE, _CODES, U, mix  # noqa: F401
from wicker.session import stage_table

HASHED = 16
# bytes of text that are encoded together: bounds the working arrays of a task
SLICE = 2 << 20


@dataclass(frozen=True)
class QualityParams:
    """sample: most labelled documents to fit on. fit_total: documents are taken, in the order of a hash, while their passages together are no more. The rest as in the formula."""

    passage: int = 64
    sample: int = 6000
    fit_total: int = 150_000
    hidden: int = 12
    steps: int = 400
    rate: float = 0.02
    decay: float = 1e-4
    seed: int = 5


_code = np.arange(256)
_SPACE = (_code <= 32)
_CLASSES = np.stack(
    [
        (_code >= 65) & (_code <= 90),
        (_code >= 97) & (_code <= 122),
        (_code >= 48) & (_code <= 57),
        _code >= 128,
        np.isin(_code, [ord(c) for c in ".,;:'\"()-"]),
        np.isin(_code, [ord(c) for c in "!?"]),
        np.isin(_code, [ord(c) for c in "#$%&*@^~+=_/\\"]),
        np.isin(_code, [ord(c) for c in "|<>[]{}`"]),
        _code == 10,
    ]
)
# one code a byte: the number of its class
_CLASS = np.where(_CLASSES.any(axis=0), _CLASSES.argmax(axis=0), 9).astype(np.uint8)
WIDTH = 10 + 9 + HASHED


def passages(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of all passages of a slice from text_batches, and where each text's begin (n + 1 numbers)."""
    data, ends = flat_bytes(column)
    texts = len(column)
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    begin = ends[:-1][np.diff(ends) > 0]
    first[begin] = word[begin]
    start = np.flatnonzero(first)
    upto = np.searchsorted(start, ends)
    words = np.diff(upto)
    many = np.maximum(1, -(-words // size))
    at = np.append(0, np.cumsum(many))
    out = np.zeros((at[-1], WIDTH), np.float32)
    if not len(start):
        return out, at
    text = np.repeat(np.arange(texts), words)
    owner = at[:-1][text] + (np.arange(len(start)) - upto[:-1][text]) // size  # passage of each word
    stop = np.append(start[1:], len(data))
    stop = np.minimum(stop, ends[1:][text])
    # classes of bytes from each word on to the next, so line breaks count with the word before
    head = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    filled = owner[head]
    low, high = start[head], np.append(stop[head[1:] - 1], stop[-1])
    classes = _CLASS[data]
    n = np.diff(np.append(head, len(owner)))
    size_of = (high - low).astype(np.float64)
    for k in range(9):
        total = np.append(0, np.cumsum(classes == k, dtype=np.int32))
        out[filled, k] = (total[high] - total[low]) / size_of
    out[filled, 9] = size_of / n / 10
    # hashes of words, without regard to case
    lower = np.where((data >= 65) & (data <= 90), data + 32, data)
    tail = np.flatnonzero(word & np.append(~word[1:], True) | np.isin(np.arange(len(data)), ends[1:] - 1) & word) + 1
    code = np.add.reduceat(_CODES[lower] * np.where(word, U(1), U(0)), start)
    code = mix(code * U(_BASE) + (tail - start).astype(U) * _CODES[lower[start]])
    length = tail - start

    def share(flag: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flag.astype(np.float64), head) / n

    same = np.append(False, (code[1:] == code[:-1]) & (text[1:] == text[:-1]))
    out[filled, 10] = share(same)
    pair = code * U(3) + np.append(code[1:], U(0))
    for k, (what, group) in enumerate(((code, owner), (pair, owner), (pair, text))):
        both = what ^ (group.astype(U) + U(1)) * U(0xD6E8FEB86659FD93)
        order = np.argsort(both, kind="stable")
        again = np.zeros(len(both), bool)
        again[order[1:]] = both[order[1:]] == both[order[:-1]]
        out[filled, 11 + k] = share(again)
    out[filled, 14] = share(length <= 2)
    out[filled, 15] = share(length >= 12)
    final = _CLASS[data[tail - 1]]
    out[filled, 16] = share((final >= 5) & (final <= 7))
    out[filled, 17] = share(length == 1)
    out[filled, 18] = n / size
    bucket = (code >> U(40)).astype(np.int64) % HASHED
    sign = np.where((code >> U(17)) & U(1), 1.0, -1.0)
    hashed = np.bincount(owner * HASHED + bucket, weights=sign, minlength=len(out) * HASHED).reshape(-1, HASHED)
    out[:, 19:] = hashed / np.sqrt(np.maximum(1, np.bincount(owner, minlength=len(out))))[:, None]
    return out, at


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class GatedAttention:
    """Parameters of the model; `score` gives the probability of label 1 for each bag."""

    mean: np.ndarray
    scale: np.ndarray
    value: np.ndarray
    gate: np.ndarray
    pick: np.ndarray
    out: np.ndarray
    bias: float

    def parts(self, vectors: np.ndarray, at: np.ndarray):
        x = np.clip((vectors - self.mean) / self.scale, -6, 6)
        t, g = np.tanh(x @ self.value), _sigmoid(x @ self.gate)
        e = (t * g) @ self.pick
        own = np.repeat(np.arange(len(at) - 1), np.diff(at))
        e = np.exp(e - np.maximum.reduceat(e, at[:-1])[own])
        a = e / np.add.reduceat(e, at[:-1])[own]
        z = np.add.reduceat(x * a[:, None], at[:-1])
        return x, t, g, a, own, z

    def score(self, vectors: np.ndarray, at: np.ndarray) -> np.ndarray:
        if len(at) < 2:
            return np.zeros(0)
        z = self.parts(vectors, at)[-1]
        return _sigmoid(z @ self.out + self.bias)


def gradients(model: GatedAttention, vectors: np.ndarray, at: np.ndarray, label: np.ndarray, decay: float) -> dict:
    """Of the mean log loss of the bags plus decay / 2 times the squares of all parameters but the bias."""
    x, t, g, a, own, z = model.parts(vectors, at)
    error = (_sigmoid(z @ model.out + model.bias) - label) / len(label)
    dz = error[:, None] * model.out
    da = (x * dz[own]).sum(axis=1)
    de = a * (da - np.add.reduceat(a * da, at[:-1])[own])
    inner = de[:, None] * model.pick
    return {
        "out": z.T @ error + decay * model.out,
        "bias": error.sum(),
        "pick": (t * g).T @ de + decay * model.pick,
        "value": x.T @ (inner * g * (1 - t * t)) + decay * model.value,
        "gate": x.T @ (inner * t * g * (1 - g)) + decay * model.gate,
    }


def fit_attention(vectors: np.ndarray, at: np.ndarray, label: np.ndarray, p: QualityParams) -> GatedAttention:
    """Full-batch Adam on the log loss of bags (vectors of bag i: at[i] to at[i+1])."""
    rng = np.random.default_rng(p.seed)
    d = vectors.shape[1]
    share = float(label.mean()) if len(label) else 0.5
    scale = vectors.std(axis=0) + 1e-3 if len(vectors) else np.ones(d)
    mean = vectors.mean(axis=0) if len(vectors) else np.zeros(d)
    model = GatedAttention(
        mean, scale, rng.normal(0, 0.1, (d, p.hidden)), rng.normal(0, 0.1, (d, p.hidden)), rng.normal(0, 0.1, p.hidden), np.zeros(d), 0.0
    )
    model.bias = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    if share in (0.0, 1.0) or not len(label):
        return model
    names = ("value", "gate", "pick", "out", "bias")
    first = {k: 0.0 for k in names}
    second = {k: 0.0 for k in names}
    for step in range(1, p.steps + 1):
        grads = gradients(model, vectors, at, label, p.decay)
        for k in names:
            first[k] = 0.9 * first[k] + 0.1 * grads[k]
            second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
            change = p.rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
            setattr(model, k, getattr(model, k) - change)
    return model


def train(docs: DataFrame, labels: DataFrame, p: QualityParams | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> GatedAttention:
    """Fit on the labelled rows given (leave held-out rows out beforehand), at most p.sample of them."""
    p = p or QualityParams()
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("label")).dropna()
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))  # labels that differ: good if one says so
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.sample)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # at most p.sample rows of two numbers
    rows = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = 0
            for texts in text_batches(batch.column("text"), SLICE):
                vectors, at = passages(texts, p.passage)
                columns = [batch.column(c).slice(seen, len(texts)) for c in ("doc_id", "label")]
                columns.append(pa.array([vectors[s:e].astype("<f4").tobytes() for s, e in zip(at, at[1:])], pa.binary()))
                seen += len(texts)
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "vectors"])

    found = rows.mapInArrow(encode, "doc_id long, label double, vectors binary")
    # of rows that repeat an id one is fitted on, with all its passages
    found = stage_table(found.groupBy("doc_id").agg(F.max("label").alias("label"), F.max("vectors").alias("vectors")), "passages")
    sizes = found.select("doc_id", (F.length("vectors") / (4 * WIDTH)).cast("long").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    upto = np.cumsum([r.n for r in sizes])
    taken = [r.doc_id for r, total in zip(sizes, upto) if total <= max(p.fit_total, sizes[0].n)]  # at most p.sample ids
    found = sorted(found.where(F.col("doc_id").isin(taken)).collect() if len(taken) < len(sizes) else found.collect(), key=lambda r: r.doc_id)
    bags = [np.frombuffer(r.vectors, "<f4").reshape(-1, WIDTH) for r in found]
    at = np.append(0, np.cumsum([len(b) for b in bags])).astype(int)
    vectors = np.concatenate(bags).astype(np.float64) if bags else np.zeros((0, WIDTH))
    return fit_attention(vectors, at, np.array([r.label for r in found]), p)


def score_quality(docs: DataFrame, model: GatedAttention, p: QualityParams | None = None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), score_col: str = "score") -> DataFrame:
    """(doc_id, *keep, score, passages) for every row; kept columns must differ from `score_col`."""
    p = p or QualityParams()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, many = [np.zeros(0)], [np.zeros(0, np.int64)]
            for texts in text_batches(batch.column(batch.num_columns - 1), SLICE):
                vectors, at = passages(texts, p.passage)
                scores.append(model.score(vectors, at))
                many.append(np.diff(at))
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns += [pa.array(np.concatenate(scores), pa.float64()), pa.array(np.concatenate(many), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *keep, F.col(text_col))
    names = rows.columns[:-1]
    # columns go by place, so kept ones may have any name
    rows = rows.toDF(*[f"c{i}" for i in range(len(names) + 1)])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    scored = rows.mapInArrow(run, f"{schema}, c{len(names)} double, c{len(names) + 1} long")
    return scored.toDF(*names, score_col, "__passages").withColumnsRenamed({} if "passages" in keep else {"__passages": "passages"})
