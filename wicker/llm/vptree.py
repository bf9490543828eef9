"""Nearest neighbours by vantage-point trees (operator 4).

Nearness is the cosine in double precision. On unit vectors it falls with the
Euclidean distance, for which the triangle inequality holds. The vectors are dealt
by hash into shards of about `shard` rows, each with a tree of its own, written
to the shared folder: a node has a vantage point and parts the other vectors at
the median distance to it; a leaf holds up to `leaf`.

A search takes all queries of a block through a shard's tree together, nearer
child first; once all have neighbours, the child nearer to most of them. A child is
left out for a query when the triangle inequality puts all of it farther than `factor`
times the distance of its last neighbour so far: factor 1 is the exact search, a smaller
one visits less. A task takes a block through several shards and leaves out what lies
farther than the last of the neighbours from the shards before, whatever the factor, as
that cannot be among the nearest. The neighbours of all tasks are then ranked.

Products in single precision tell which points of a leaf may be near enough; only these
are scored, in double precision.

Equal vectors are one point of a tree with all their ids, of which a query needs
the first few, so a vector that fills a third of the table costs nothing extra. The tree
compares unit vectors; whatever lies within rounding of a query's last neighbour is
then scored on the original vectors and ranked by that score and the id, so ties,
as between multiples of one vector, go to the smaller id.

Defined cases: vectors that are NULL, zero, hold NULL or non-finite components, or
differ in length from most others of the indexed table take no part; rows with a NULL
id take no part; a row is no candidate of its own id; of rows that repeat an id the
one with the least vector counts, among candidates and among queries; fewer candidates
than asked for are all given; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import io
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wicker.llm.token_files import open_fs, shared_uri

ROUNDING = 1e-12  # between a cosine of unit vectors and that of the original ones


@dataclass(frozen=True)
class TreeParams:
    """factor: see above; 1 searches exactly."""

    shard: int = 8192
    leaf: int = 128
    block: int = 512
    # shards that a task takes a block through at most
    span: int = 64
    factor: float = 0.95
    seed: int = 3


@dataclass(frozen=True)
class Index:
    """A written index: folder, number of shards, components of its vectors."""

    path: str
    shards: int
    length: int


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that could take part, v as floats if it has them and else as doubles, whatever its length."""
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))


def dealt(rows: DataFrame, length: int, parts: int, name: str) -> DataFrame:
    """(name, id, v), one row of each id with vectors of the given length, dealt by id and in order of `name`.

    Rows are dealt before ids are made one, so that vectors are shuffled once.
    """
    rows = rows.where(F.size("v") == length).withColumn(name, F.pmod(F.xxhash64("id"), F.lit(parts)))
    return rows.repartition(parts, name).groupBy(name, "id").agg(F.min("v").alias("v")).sortWithinPartitions(name).select(name, "id", "v")


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _save(uri: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    store, folder = open_fs(uri)
    body = io.BytesIO()
    np.savez(body, **arrays)
    own = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        out.write(body.getvalue())
    store.move(own, f"{folder}/{name}")


def _load(uri: str, name: str) -> dict[str, np.ndarray] | None:
    from pyarrow import fs

    store, folder = open_fs(uri)
    if store.get_file_info(f"{folder}/{name}").type == fs.FileType.NotFound:
        return None  # a shard or block that no row fell into
    with store.open_input_stream(f"{folder}/{name}") as f:
        return dict(np.load(io.BytesIO(f.read())))


def _groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, pa.Table]]:
    """Tables of rows with one value of a sorted column."""
    held, last = [], None
    for batch in batches:
        own = batch.column(column).to_numpy()
        cut = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
        for s, e in zip(cut, cut[1:]):
            if s == e:
                continue
            if own[s] != last and held:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(s, e - s))
            last = int(own[s])
    if held:
        yield last, pa.Table.from_batches(held)


def grow(ids: np.ndarray, vectors: np.ndarray, leaf: int, seed: int) -> dict[str, np.ndarray]:
    """The arrays of a tree. Points are distinct vectors in the order of the nodes, as given, each with its ids in order."""
    order = np.lexsort(ids[None, :])
    ids, vectors = ids[order], np.ascontiguousarray(vectors[order] + 0.0)
    _, first, which = np.unique(vectors.view([("", vectors.dtype)] * vectors.shape[1]).ravel(), return_index=True, return_inverse=True)
    points = vectors[first]
    unit = points.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    rng = np.random.default_rng(seed)
    perm = np.arange(len(points))
    nodes: list[list[float]] = []  # low, high, left, right, and the bounds of both children's distances; the vantage point is at low

    def build(low: int, high: int) -> int:
        at = len(nodes)
        nodes.append([low, high, -1, -1, 0, 0, 0, 0])
        if high - low > leaf:
            pick = low + int(rng.integers(high - low))
            perm[[low, pick]] = perm[[pick, low]]
            rest = perm[low + 1 : high]
            away = np.linalg.norm(unit[rest] - unit[perm[low]], axis=1)
            ranked = np.argsort(away, kind="stable")
            perm[low + 1 : high], away = rest[ranked], away[ranked]
            half = len(away) // 2
            middle = low + 1 + half
            bounds = [away[0], away[half - 1], away[half], away[-1]]
            left, right = build(low + 1, middle), build(middle, high)
            nodes[at] = [low, high, left, right, *bounds]
        return at

    build(0, len(points))
    which = np.argsort(perm)[which]
    upto = np.append(0, np.cumsum(np.bincount(which)))
    return {"ids": ids[np.argsort(which, kind="stable")], "upto": upto, "points": points[perm], "nodes": np.array(nodes, np.float64)}


def _distance(score: np.ndarray) -> np.ndarray:
    """The distance of unit vectors with this cosine, not rounded down."""
    return np.sqrt(np.maximum(0, 2 - 2 * (score - ROUNDING))) + 1e-9


def search_tree(
    tree: dict[str, np.ndarray], ids: np.ndarray, vectors: np.ndarray, k: int, factor: float, known: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, id, score) of up to k nearest of each query, its own id left out. `known`: scores under which nothing is wanted."""
    vectors, given, nodes = vectors.astype(np.float64), tree["points"].astype(np.float64), tree["nodes"]
    lengths = np.linalg.norm(given, axis=1)
    unit, points = vectors / np.linalg.norm(vectors, axis=1)[:, None], given / lengths[:, None]
    single, asked_single = points.astype(np.float32), unit.astype(np.float32)
    slack = (unit.shape[1] + 8) * 2.0**-23  # more than a product in single precision is off
    keep = k + 1  # one point may be the query itself
    n = len(ids)
    known = np.full(n, -np.inf) if known is None else known
    best = np.full((n, keep), -np.inf)  # exact scores, falling
    who = np.full((n, keep), -1, np.int64)
    least = np.full((n, keep), np.iinfo(np.int64).max)  # the least id of each point
    limit = np.full(n, np.inf)
    farthest = _distance(known)
    own_length = np.sqrt((vectors * vectors).sum(axis=1))
    first_id = tree["ids"][tree["upto"][:-1]] if len(points) else tree["ids"]

    def offer(q: np.ndarray, low: int, high: int) -> None:
        near = asked_single[q] @ single[low:high].T
        floor = np.maximum(best[q, -1], known[q])
        rough = floor - slack
        if high - low > keep and np.isneginf(rough).any():  # as many as are kept lie in this leaf alone
            rough = np.maximum(rough, np.partition(near, -keep, axis=1)[:, -keep] - 2 * slack)
        row, point = np.divmod(np.flatnonzero(near >= rough.astype(np.float32)[:, None]), high - low)
        asked, point = q[row], point + low
        score = (given[point] * vectors[asked]).sum(axis=1) / (lengths[point] * own_length[asked])
        fine = score >= floor[row] - ROUNDING
        if not fine.any():
            return
        asked, point, score = asked[fine], point[fine], score[fine]
        some = np.unique(asked)
        owner = np.concatenate((asked, np.repeat(some, keep)))
        value, name, id_ = np.concatenate((score, best[some].ravel())), np.concatenate((point, who[some].ravel())), np.concatenate((first_id[point], least[some].ravel()))
        order = np.lexsort((id_, -value, owner))
        owner, value, name, id_ = owner[order], value[order], name[order], id_[order]
        begins = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        take = (begins[:, None] + np.arange(keep)).ravel()  # every owner has its former entries, so at least `keep`
        best[some], who[some], least[some] = (x[take].reshape(-1, keep) for x in (value, name, id_))
        limit[some] = _distance(best[some, -1])

    def visit(node: int, q: np.ndarray) -> None:
        low, high, left, right = map(int, nodes[node, :4])
        bound = nodes[node, 4:]
        if left < 0:
            offer(q, low, high)
            return
        offer(q, low, low + 1)
        away = np.linalg.norm(unit[q] - points[low], axis=1)
        apart = {left: np.maximum(bound[0] - away, away - bound[1]), right: np.maximum(bound[2] - away, away - bound[3])}
        inner = away <= (bound[1] + bound[2]) / 2
        # queries without a limit go to their nearer child first, as that sets it; others stay together
        for turn in (inner, ~inner) if np.isinf(np.minimum(limit[q], farthest[q])).any() else (np.full(len(q), True),):
            for child in (left, right) if 2 * inner[turn].sum() >= turn.sum() else (right, left):
                use = turn & (apart[child] <= np.minimum(factor * limit[q], farthest[q]))
                if use.any():
                    visit(child, q[use])

    if len(points) and n:
        visit(0, np.arange(n))
    row, col = np.nonzero(who >= 0)
    point, score, upto = who[row, col], best[row, col], tree["upto"]
    names = np.minimum(upto[point + 1] - upto[point], keep)
    each = np.repeat(np.arange(len(point)), names)
    found = tree["ids"][upto[point][each] + np.arange(len(each)) - (np.cumsum(names) - names)[each]]
    row, score = row[each], score[each]
    other = found != ids[row]
    row, found, score = row[other], found[other], score[other]
    order = np.lexsort((found, -score, row))
    row, found, score = row[order], found[order], score[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], found[first], score[first]


def search_trees(trees: Iterator[dict[str, np.ndarray]], ids: np.ndarray, vectors: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, id, score) of the nearest of each query in several trees: k, and more that tie with the last of them."""
    top = np.full((len(ids), k), -np.inf)
    found = [(np.array([], np.int64), np.array([], np.int64), np.array([], np.float64))]
    for tree in trees:
        at, id_, score = search_tree(tree, ids, vectors, k, factor, top[:, -1])
        found.append((at, id_, score))
        here = np.full((len(ids), k), -np.inf)
        here[at, np.arange(len(at)) - np.searchsorted(at, at)] = score
        top = -np.sort(-np.concatenate((top, here), axis=1), axis=1)[:, :k]
    at, id_, score = map(np.concatenate, zip(*found))
    kept = score >= top[at, -1]
    return at[kept], id_[kept], score[kept]


def build_index(vectors: DataFrame, path: str, params: TreeParams | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> Index:
    """Write a tree for every shard of all usable rows to `path`, a folder that driver and executors share."""
    p = params or TreeParams()
    spark = vectors.sparkSession
    uri = shared_uri(spark, path)
    store, folder = open_fs(uri)
    store.create_dir(folder, recursive=True)
    rows = usable(vectors, id_col, vector_col)
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("count"), F.count_distinct("id").alias("ids"))
    sizes = sizes.orderBy(F.desc("count"), "n").limit(1).collect()
    length = sizes[0].n if sizes else 0
    shards = max(1, math.ceil((sizes[0].ids if sizes else 0) / p.shard))
    leaf, seed = p.leaf, p.seed

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, table in _groups(batches, "shard"):
            tree = grow(table["id"].to_numpy(), _matrix(table["v"].combine_chunks()), leaf, seed)
            _save(uri, f"tree-{shard:06d}", tree)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "rows": pa.array([table.num_rows], pa.int64())})

    dealt(rows, length, shards, "shard").mapInArrow(write, "shard long, rows long").agg(F.sum("rows")).collect()
    return Index(uri, shards, length)


def search(index: Index, queries: DataFrame, k: int, params: TreeParams | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of every usable query row, ties to the smaller id."""
    p = params or TreeParams()
    spark: SparkSession = queries.sparkSession
    uri, shards = index.path, index.shards
    rows = usable(queries, id_col, vector_col)
    count = max(1, math.ceil(rows.where(F.size("v") == index.length).select("id").distinct().count() / p.block))
    name = uuid.uuid4().hex[:12]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, table in _groups(batches, "block"):
            _save(uri, f"queries-{name}-{block:06d}", {"ids": table["id"].to_numpy(), "v": _matrix(table["v"].combine_chunks())})
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64())})

    dealt(rows, index.length, count, "block").mapInArrow(write, "block long").count()
    factor = p.factor
    # every block of queries meets every shard: a task takes a block through `span` of them, or fewer where cores would idle
    tasks = 2 * spark.sparkContext.defaultParallelism
    span = max(1, min(p.span, math.ceil(shards / math.ceil(tasks / count))))
    spans = math.ceil(shards / span)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for meeting in batch.column("id").to_pylist():
                block, part = divmod(meeting, spans)
                asked = _load(uri, f"queries-{name}-{block:06d}")
                if asked is None:
                    continue
                trees = (_load(uri, f"tree-{shard:06d}") for shard in range(part * span, min(shards, (part + 1) * span)))
                at, found, scores = search_trees((t for t in trees if t is not None), asked["ids"], asked["v"], k, factor)
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(asked["ids"][at]), "vec_id": pa.array(found), "score": pa.array(scores)})

    meetings = spark.range(0, spans * count, 1, min(spans * count, 100_000))
    found = meetings.mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
