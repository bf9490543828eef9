import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa

from wicker.llm.encode import text_batches
from wicker.llm.queries import op12_importance_resampling
from wicker.llm.resample import ResampleParams, grams, resample

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS.findall(low)
    return len(words), [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def naive(docs, target, p):
    def counts(texts):
        return Counter(zlib.crc32(f.encode()) % p.buckets for t in texts for f in features(t, p.longest)[1])

    s, t = counts(x for _, x in docs), counts(target)
    all_s, all_t = sum(s.values()) + p.buckets, sum(t.values()) + p.buckets
    rows = []
    for i, text in docs:
        words, found = features(text, p.longest)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in (zlib.crc32(f.encode()) % p.buckets for f in found))
        h = int(hashlib.sha256(f"{p.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= p.least_words), key=lambda r: (-r[4], -1 if r[0] is None else r[0]))
    draw = len(able) * p.percent // 100
    ranks = {}
    for place, r in enumerate(able[:draw], 1):
        ranks.setdefault(r, []).append(place)
    out = []
    for r in rows:
        out.append((*r, ranks[r].pop(0) if ranks.get(r) else None))
    return sorted(out, key=repr)


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = ["the", "Cat", "sat", "ÉTÉ", "naïve", "x9", "日本", "a", "of", "Hat", "\x85q", "don't"]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) + rng.choice(["", ".", "\n", " !"])) for i in range(n)]


COLUMNS = ("doc_id", "n_words", "n_features", "weight", "score", "rank")


def test_against_brute_force(spark, docs_of, odd_rows, rows):
    docs = corpus(200) + odd_rows
    target = ["the cat sat on été", "日本 hat x9 x9", "", None]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    for p in (ResampleParams(), ResampleParams(longest=3, buckets=97, percent=37, least_words=5, seed="s")):
        assert rows(resample(docs_of(docs), bench, p), *COLUMNS) == naive(docs, target, p)


def test_hot_words_and_many_partitions(spark, docs_of, rows):
    docs = [(i, "the " * 30) for i in range(150)] + corpus(50, 2)
    bench = spark.createDataFrame([(1, "the the")], "item_id long, text string")
    p = ResampleParams(percent=50)
    assert rows(resample(docs_of(docs).repartition(13), bench, p), *COLUMNS) == naive(docs, ["the the"], p)


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resample(docs_of([]), none).count() == 0
    assert resample(docs_of([(1, "x")]), none).collect()[0]["rank"] is None


def test_ngrams_stay_in_their_text():
    found = grams(next(text_batches(pa.array(["a b c", "", "d", "c a b c"], pa.large_string()))), 3)
    named = [sorted((int(t), d[int(n)].as_py()) for n, t in zip(number, text)) for d, number, text in zip(found.distinct, found.number, found.text)]
    assert named[1] == [(0, "a b"), (0, "b c"), (3, "a b"), (3, "b c"), (3, "c a")]
    assert named[2] == [(0, "a b c"), (3, "a b c"), (3, "c a b")]


def test_query(spark, docs_of, rows, tmp_path):
    docs = corpus(120, 3)
    docs_of(docs).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "the cat x9")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = [(r[0], *r[2:]) for r in naive(docs, ["the cat x9"], ResampleParams())]
    assert rows(op12_importance_resampling(spark, str(tmp_path)), "doc_id", "n_features", "weight", "score", "rank") == sorted(want, key=repr)
