import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from wicker.llm.components import components
from wicker.llm.darts import bands, sketch
from wicker.llm.decontaminate import LeakParams, find_leaks, without_leaks
from wicker.llm.near_dup import NearDupParams, near_duplicates, one_of_each
from wicker.llm.vptree import TreeParams, build_index, dealt, grow, search, search_tree, search_trees, usable


def test_darts_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.8):
        errors = []
        for _ in range(25):
            n = int(rng.integers(5, 400))
            one = rng.integers(0, 1 << 64, n, dtype=np.uint64)
            two = one.copy()
            cut = int(n * (1 - share) / (1 + share))
            two[:cut] = rng.integers(0, 1 << 64, cut, dtype=np.uint64)
            w1, w2 = rng.exponential(2, n) + 0.1, rng.exponential(2, n) + 0.1
            w2[cut:] = w1[cut:]
            a, b = dict(zip(one, w1)), dict(zip(two, w2))
            true = sum(min(a.get(x, 0), b.get(x, 0)) for x in {*a, *b}) / sum(max(a.get(x, 0), b.get(x, 0)) for x in {*a, *b})
            both = sketch(np.append(one, two), np.repeat([0, 1], n), np.append(w1, w2), 3, 128)
            errors.append((both[0] == both[1]).mean() - true)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08
    assert (both[2] == both[2].max()).all() and (both[:2] != both[2].max()).all()
    assert bands(both, 4, 8).shape == (3, 4)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1040)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    assert got == {x: find(x) for x in parent}


def weights(text):
    words = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", text.lower())
    return Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else Counter()


def brute_classes(rows):
    texts = sorted({t or "" for _, t in rows})
    sets = [weights(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            low = sum((sets[i] & sets[j]).values())
            if low and low >= 0.8 * (sum(sets[i].values()) + sum(sets[j].values()) - low):
                parent[find(i)] = find(j)
    least = {}
    for i, t in rows:
        c = find(texts.index(t or ""))
        least[c] = min((x for x in (i, least.get(c)) if x is not None), default=None)
    return sorted((str(i), str(least[find(texts.index(t or ""))])) for i, t in rows)


def family(rng, words, copies, edits):
    out = [" ".join(words)]
    for _ in range(copies):
        own = list(words)
        for _ in range(rng.randint(1, edits)):
            own[rng.randrange(len(own))] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def test_near_duplicates(docs_of, odd_rows):
    rng = random.Random(5)
    texts = []
    for size, copies, edits in ((60, 25, 3), (200, 40, 8), (30, 6, 1), (8, 3, 1)):
        texts += family(rng, [f"v{rng.randrange(10**6)}" for _ in range(size)], copies, edits)
    texts += ["the same words " * 40, "the same words " * 41, "the same words " * 60]
    rows = [(100 + i, t) for i, t in enumerate(texts)] + odd_rows + [(400, texts[3]), (None, texts[3])]
    rng.shuffle(rows)
    # small blocks, so that buckets are compared block by block
    got = near_duplicates(docs_of(rows), NearDupParams(block=8)).collect()
    assert sorted((str(r.doc_id), str(r.class_id)) for r in got) == brute_classes(rows)
    kept = one_of_each(docs_of(rows))
    assert kept.columns == docs_of(rows).columns
    assert kept.count() == len({r.class_key for r in got})
    assert near_duplicates(docs_of([])).count() == 0


def brute_nearest(ids, vectors, queries, k):
    lengths = np.linalg.norm(vectors, axis=1)
    out = {}
    for q in queries:
        own = vectors[ids == q][0]
        score = (vectors * own).sum(1) / (lengths * np.linalg.norm(own))
        use = ids != q
        best = np.lexsort((ids[use], -score[use].round(14)))[:k]
        out[q] = ids[use][best].tolist()
    return out


def test_tree_is_exact_with_factor_one():
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(700, 8))
    vectors[100:400] = vectors[7]  # ties
    ids = np.arange(700)
    tree = grow(ids, vectors, 16, 1)
    asked = np.arange(0, 700, 10)
    at, found, _ = search_tree(tree, asked, vectors[asked], 5, 1.0)
    want = brute_nearest(ids, vectors, asked, 5)
    assert {int(q): found[at == i].tolist() for i, q in enumerate(asked)} == {int(q): w for q, w in want.items()}


def test_index_over_shards(spark, tmp_path):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    vectors = centres[rng.integers(12, size=900)] + rng.normal(scale=0.3, size=(900, 16))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    bad = [(901, None, 0), (902, [0.0] * 16, 0), (903, [float("nan")] * 16, 0), (904, [None] + [1.0] * 15, 0), (905, [1.0], 0), (None, [1.0] * 16, 0), rows[3]]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, rank int")
    p = TreeParams(shard=200, leaf=16, block=30)
    index = build_index(table, f"{tmp_path}/trees", p)
    asked = table.where("vec_id % 5 = 0")
    got = search(index, asked, 5, p).collect()
    want = brute_nearest(np.arange(900), vectors, range(0, 900, 5), 5)
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert set(found) == set(want)
    assert sum(len({*found[q]} & {*want[q]}) for q in want) >= 0.97 * 5 * len(want)
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>, rank int")
    assert search(build_index(few, f"{tmp_path}/few", p), few, 5, p).count() == 6
    none = build_index(table.limit(0), f"{tmp_path}/none", p)
    assert search(none, table.limit(0), 5, p).count() == 0


def test_short_benchmark_items(spark, docs_of, odd_rows):
    rng = random.Random(8)
    long = " ".join(f"q{k}" for k in range(9))
    items = [(0, "Red blue."), (1, "red"), (2, "one two three four"), (3, "  ... "), (4, None), (5, long), (6, "red blue"), (0, "red blue")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, "a red, BLUE b red blue"), (2, "red"), (3, "blue red"), (4, "x one two three four"), (5, "one two three"), (6, long + " red"), (7, "redblue"), (7, "red"), (None, "red")]
    rows += [(k, " ".join(rng.choice(("red", "blue", "one", "two", "three", "four")) for _ in range(60))) for k in range(50, 60)] + odd_rows
    want = []
    for i, text in rows:
        words = re.findall(r"\w+", (text or "").lower())
        for item, its in ((0, ["red", "blue"]), (1, ["red"]), (2, ["one", "two", "three", "four"]), (5, long.split()), (6, ["red", "blue"])):
            at = [s for s in range(len(words)) if words[s : s + len(its)] == its]
            if at:
                want.append((str(i), item, at[0], 1.0))
    for limit in (0, 500_000):
        p = LeakParams(short_items=True, broadcast_limit=limit)
        got = find_leaks(docs_of(rows), bench, p).collect()
        assert sorted((str(r.doc_id), r.item_id, r.start, r.similarity) for r in got) == sorted(want)
    clean = without_leaks(docs_of(rows), bench, LeakParams(short_items=True))
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(i) for i, t in rows if not re.search(r"\bred\b|\bone two three four\b", (t or "").lower()))


def test_leaks(spark, docs_of, odd_rows):
    rng = random.Random(6)
    items = [" ".join(f"q{rng.randrange(3000)}" for _ in range(n)) for n in (12, 20, 33, 57, 5, 3)]
    bench = spark.createDataFrame([*enumerate(items), (99, None), (0, items[0])], "item_id long, text string")

    def noise(n):
        return " ".join(f"n{rng.randrange(10**6)}" for _ in range(n))

    def changed(text, at):
        words = text.split()
        words[at] = "other"
        return " ".join(words)

    rows = [(k, f"{noise(40)}. {t.upper()}! {noise(25)}") for k, t in enumerate(items)]
    rows += [(10, changed(items[3], 0)), (11, changed(items[3], 28)), (12, changed(items[0], 6)), (13, " ".join(items[3].split()[:50])), (14, items[3][: len(items[3]) // 2])]
    rows += [(20, rows[1][1]), (20, rows[1][1]), (None, rows[1][1]), *odd_rows]
    got = find_leaks(docs_of(rows), bench).collect()
    bags = [weights(t) for t in items]
    want, held = [], set()
    for i, text in rows:
        words = re.findall(r"\w+", (text or "").lower())
        for item, bag in enumerate(bags[:5]):
            n = len(items[item].split())
            best = 0.0
            for s in range(max(1, len(words) - n + 1)):
                own = weights(" ".join(words[s : s + n])) if len(words) >= 5 else Counter()
                same = sum((own & bag).values())
                best = max(best, same / (sum(own.values()) + sum(bag.values()) - same))
            if best >= 0.8:
                want.append((str(i), item, round(best, 9)))
                held.add(text)
    assert sorted((str(r.doc_id), r.item_id, round(r.similarity, 9)) for r in got) == sorted(want)
    assert {10, 11, 13} <= {r.doc_id for r in got} and not {12, 14} & {r.doc_id for r in got}
    clean = without_leaks(docs_of(rows), bench)
    assert clean.count() == sum(t not in held for _, t in rows) and clean.columns == docs_of(rows).columns
    assert find_leaks(docs_of([]), bench).count() == find_leaks(docs_of(rows), bench.limit(0)).count() == 0
    shuffled = find_leaks(docs_of(rows), bench, LeakParams(broadcast_limit=0)).collect()
    assert sorted(map(str, shuffled)) == sorted(map(str, got))


def test_ties_between_multiples_of_a_vector_go_to_the_smaller_id():
    rng = np.random.default_rng(8)
    base = rng.normal(size=(300, 16))
    vectors = np.vstack([base, np.stack([base[0] * 2.0**e for e in range(-20, 20)]), base[0][None] * 3.1, base[:50]])
    ids = rng.permutation(len(vectors)).astype(np.int64)
    at, found, scores = search_tree(grow(ids, vectors, 8, 3), ids, vectors, 5, 1.0)
    lengths = np.linalg.norm(vectors, axis=1)
    for i, own in enumerate(vectors):
        exact = (vectors * own).sum(axis=1) / (lengths * np.sqrt((own * own).sum()))
        want = sorted((-s, int(v)) for s, v in zip(exact, ids) if v != ids[i])[:5]
        assert [(-s, int(v)) for s, v in zip(scores[at == i], found[at == i])] == want


def test_mixed_lengths_and_repeated_ids(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)] + [(100 + i, rng.normal(size=4).tolist()) for i in range(20)]
    rows += [(5, rng.normal(size=8).tolist()), (5, rng.normal(size=8).tolist()), (105, rng.normal(size=8).tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = build_index(table, f"{tmp_path}/mixed", TreeParams(shard=16, leaf=4, block=7, factor=1.0))
    assert index.length == 8
    # most queries are of the other length: they take no part, and the index keeps its own
    asked = table.where("vec_id >= 100 OR vec_id = 5 OR vec_id = 7")
    kept = {}
    for i, v in rows:
        if len(v) == 8:
            kept[i] = min(v, kept.get(i, v))
    ids, vectors = np.array(list(kept)), np.array(list(kept.values()))
    want = brute_nearest(ids, vectors, [5, 7, 105], 5)
    found = {}
    for r in sorted(search(index, asked, 5, TreeParams(shard=16, leaf=4, block=7, factor=1.0)).collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert found == want


def test_equal_words_against_an_item_are_linear_in_the_text(spark):
    docs = spark.createDataFrame([(1, "spam " * 20_000), (2, "spam " * 14), (3, "eggs " * 100)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "spam " * 15)], "item_id long, text string")
    began = time.time()
    found = find_leaks(docs, items).collect()
    assert sorted((r.doc_id, r.item_id, r.start, r.similarity) for r in found) == [(1, 7, 0, 1.0), (2, 7, 0, pytest.approx(10 / 11))]
    assert time.time() - began < 60


def test_neighbours_of_former_trees_narrow_the_search_in_later_ones():
    rng = np.random.default_rng(11)
    vectors = rng.normal(size=(3000, 12))
    vectors[200:230], vectors[300:310] = vectors[5], 4 * vectors[6]  # ties within a tree and between trees
    ids = rng.permutation(3000).astype(np.int64)
    shard = rng.integers(0, 6, 3000)
    trees = [grow(ids[shard == s], vectors[shard == s], 16, 3) for s in range(6)]
    asked = np.arange(0, 3000, 20)
    lengths = np.linalg.norm(vectors, axis=1)
    at, found, scores = search_trees(iter(trees), ids[asked], vectors[asked], 5, 1.0)
    for i, q in enumerate(asked):
        exact = (vectors * vectors[q]).sum(axis=1) / (lengths * np.sqrt((vectors[q] * vectors[q]).sum()))
        want = sorted((-s, int(v)) for s, v in zip(exact, ids) if v != ids[q])[:5]
        got = sorted(zip((-scores[at == i]).tolist(), found[at == i].tolist()))
        assert got[:5] == want and all(s <= want[-1][0] for s, _ in got)
    # nothing under the known scores comes out, and all that reaches them does
    alone = search_tree(trees[1], ids[asked], vectors[asked], 5, 1.0)
    known = np.array([np.sort(scores[at == i])[0] for i in range(len(asked))])
    rest = search_tree(trees[1], ids[asked], vectors[asked], 5, 1.0, known)
    assert len(rest[0]) < len(alone[0]) / 2
    wanted = {(r, f) for r, f, s in zip(*alone) if s >= known[r]}
    assert wanted <= {*zip(rest[0].tolist(), rest[1].tolist())} <= {*zip(alone[0].tolist(), alone[1].tolist())}


def test_single_precision_leaves_no_neighbour_out():
    rng = np.random.default_rng(12)
    near = rng.normal(size=64) + rng.normal(scale=1e-7, size=(400, 64))  # closer together than single precision tells apart
    ids = np.arange(400)
    at, found, _ = search_tree(grow(ids, near, 16, 3), ids[::10], near[::10], 5, 1.0)
    lengths = np.linalg.norm(near, axis=1)
    for i, q in enumerate(ids[::10]):
        exact = (near * near[q]).sum(axis=1) / (lengths * np.sqrt((near[q] * near[q]).sum()))
        assert found[at == i].tolist() == sorted(np.delete(ids, q).tolist(), key=lambda v: (-exact[v], v))[:5]


def test_meetings_are_ranges_and_only_neighbours_are_shuffled(spark, tmp_path):
    rng = np.random.default_rng(13)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(600, 8)))], "vec_id long, embedding array<double>")
    p = TreeParams(shard=20, leaf=8, block=200)
    found = search(build_index(table, f"{tmp_path}/spans", p), table, 5, p)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "hashpartitioning(query_id" in plan
    assert found.count() == 3000


def test_vectors_are_shuffled_once_and_as_they_are(spark):
    rows = [(1, [3.0, 1.0]), (1, [2.0, 9.0]), (2, [1.5, 0.1]), (3, [1.0]), (None, [1.0, 1.0]), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, None)]
    for kind in ("float", "double"):
        table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
        found = dealt(usable(table, "vec_id", "embedding"), 2, 5, "shard")
        assert dict(found.dtypes)["v"] == f"array<{kind}>"
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1 and "hashpartitioning(shard" in plan
        assert sorted((r.id, [round(x, 6) for x in r.v]) for r in found.collect()) == [(1, [2.0, 9.0]), (2, [1.5, 0.1])]


def test_a_tree_holds_vectors_once_as_they_were_given():
    vectors = np.random.default_rng(14).normal(size=(300, 8)).astype(np.float32)
    tree = grow(np.arange(300), vectors, 16, 3)
    assert [k for k, x in tree.items() if x.size == vectors.size] == ["points"] and tree["points"].dtype == np.float32
    for a, b in zip(search_tree(tree, np.arange(300), vectors, 5, 1.0), search_tree(grow(np.arange(300), vectors.astype(np.float64), 16, 3), np.arange(300), vectors.astype(np.float64), 5, 1.0)):
        assert np.array_equal(a, b)
