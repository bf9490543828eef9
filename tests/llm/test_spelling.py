import random
import re
import zlib
from collections import Counter

import numpy as np

from wicker.llm.queries import op11_spelling_variants
from wicker.llm.spelling import SpellingParams, near_pairs, signatures_of, spelling_variants, words_of_texts


def within_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    return any(a[:i] == b[:i] and (a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]) for i in range(len(b)))


def naive_words(docs, noise=31, least=7, count=2):
    found = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            if noise and h % noise == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            if len(low) >= least:
                found[low] += 1
    return {w: n for w, n in found.items() if n >= count}


def naive(words, times=10):
    near = {w: [x for x in words if within_one(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=repr)


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def misspelt(rng, word):
    kind, at = rng.randrange(3), rng.randrange(len(word))
    letter = rng.choice("abcdeé")
    return (word[:at] + letter + word[at + 1 :], word[:at] + word[at + 1 :], word[:at] + letter + word[at:])[kind]


def vocabulary(rng, size):
    words = {"".join(rng.choice("abcde") for _ in range(rng.randint(7, 10))) for _ in range(size)}
    words |= {misspelt(rng, w) for w in list(words)} | {misspelt(rng, w) for w in list(words)[: size // 4]}
    return {w: int(10 ** rng.uniform(0, 4)) + 2 for w in words if len(w) >= 7}


def test_signatures_miss_no_pair():
    rng = random.Random(1)
    words = sorted(vocabulary(rng, 400))
    for segments in (1, 2, 3, 4):
        marks, short = signatures_of(words, segments)
        sets = [(set(m[short].tolist()), set(m.tolist())) for m in marks]
        for i, a in enumerate(words):
            for k, b in enumerate(words[: i]):
                if within_one(a, b):
                    x, y = (i, k) if len(a) <= len(b) else (k, i)
                    assert sets[x][0] & sets[y][1], (a, b)
    assert signatures_of([], 3)[0].shape[0] == 0
    assert np.array_equal(*(signatures_of(["ÿ𝒳abcdefg"], 3)[0] for _ in range(2)))


def test_variants_against_brute_force(spark, rows):
    rng = random.Random(2)
    words = vocabulary(rng, 300)
    words |= {"chainaa": 100_000, "chainab": 9_000, "chainbb": 800, "chaibbb": 70, "chabbbb": 6, "tiedone": 500, "tiedoze": 500, "tiedoxe": 5}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows(spelling_variants(frame), *COLUMNS) == naive(words)


def test_a_hot_signature(spark, rows):
    # one long stem before 600 endings: all share letters and segments
    words = {"stemstemstem" + a + b: 2 for a in "abcdefghijklmnopqrstuvwxyzàáâã" for b in "abcdefghijklmnopqrst"}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    found = near_pairs(frame, SpellingParams()).count()
    assert found == 30 * (20 * 19 // 2) + 20 * (30 * 29 // 2)


def test_words_of_texts(spark, docs_of, odd_rows, rows):
    rng = random.Random(3)
    names = ["Letters", "ÀÉÎÕÜÿß", "another×word", "short", "wörterbuch", "MiXeDcase", "x"]
    docs = [(i, " ".join(rng.choice(names) for _ in range(200))) for i in range(30)] + odd_rows + [(None, "nothing nothing"), (8, "repeats repeats")] * 2
    assert dict(rows(words_of_texts(docs_of(docs), SpellingParams(noise=31)), "word", "n")) == naive_words(docs)
    assert dict(rows(words_of_texts(docs_of(docs), SpellingParams()), "word", "n")) == naive_words(docs, noise=0)


def test_query(spark, docs_of, odd_rows, rows, tmp_path):
    rng = random.Random(4)
    words = vocabulary(rng, 60)
    text = [w for w, n in words.items() for _ in range(min(n, 40))]
    rng.shuffle(text)
    docs = [(i, " ".join(text[i::20])) for i in range(20)] + odd_rows
    docs_of(docs).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    assert rows(op11_spelling_variants(spark, str(tmp_path)), *COLUMNS) == naive(naive_words(docs))


def test_empty_tables(spark, docs_of):
    assert spelling_variants(words_of_texts(docs_of([]), SpellingParams())).count() == 0
    assert spelling_variants(words_of_texts(docs_of([(1, None), (2, "")]), SpellingParams())).count() == 0
