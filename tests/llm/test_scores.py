import math
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from wicker.llm.encode import text_batches
from wicker.llm.quality import QualityParams, fit_attention, gradients, passages, score_quality, train
from wicker.llm.queries import op1_quality, op6_toxicity
from wicker.llm.toxicity import EXCEPTIONS, Lexicon, ToxicityParams, automaton, density, fold, learn_lexicon, score_toxicity, visible


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n)) + "."


def corpus(seed=1):
    rng = random.Random(seed)
    good = [prose(rng, rng.randint(20, 300)) for _ in range(60)]
    bad = [" ".join(w.upper() + "!!" for w in prose(rng, rng.randint(20, 300)).split()) for _ in range(60)]
    return [(i, t) for i, t in enumerate(good + bad)], [(i, int(i < 60), int(i % 2)) for i in range(120)]


def test_passages_cover_the_whole_text():
    texts = ["", " \n ", "a b c", "x " * 200, "last"]
    vectors, at = passages(next(text_batches(pa.array(texts))), 64)
    assert np.diff(at).tolist() == [1, 1, 1, 4, 1]
    assert not vectors[:2].any() and np.isfinite(vectors).all()
    # a text's passages do not depend on its neighbours
    for i, t in enumerate(texts):
        own, _ = passages(next(text_batches(pa.array([t]))), 64)
        assert np.allclose(own, vectors[at[i] : at[i + 1]])


def test_attention_finds_the_telling_passage():
    rng = np.random.default_rng(0)
    bags, label = [], []
    for k in range(200):
        bag = rng.normal(0, 1, (rng.integers(2, 12), 6))
        if k % 2:
            bag[rng.integers(len(bag)), 0] = 6
        bags.append(bag)
        label.append(k % 2)
    at = np.append(0, np.cumsum([len(b) for b in bags]))
    model = fit_attention(np.concatenate(bags), at, np.array(label, float), QualityParams(steps=300))
    assert ((model.score(np.concatenate(bags), at) > 0.5) == np.array(label, bool)).mean() > 0.95


def test_quality(spark, docs_of, odd_rows):
    rows, marks = corpus()
    labels = spark.createDataFrame([m for m in marks if m[0] % 3], "doc_id long, quality int, toxic int")
    model = train(docs_of(rows), labels)
    got = {r.doc_id: r.score for r in score_quality(docs_of(rows), model).collect()}
    assert all((got[i] >= 0.5) == bool(q) for i, q, _ in marks)
    odd = score_quality(docs_of(odd_rows), model).collect()
    assert len(odd) == len(odd_rows) and all(0 <= r.score <= 1 for r in odd)
    assert score_quality(docs_of([]), model).count() == 0
    none = train(docs_of(rows), labels.limit(0))
    assert {r.score for r in score_quality(docs_of(rows), none).collect()} == {0.5}


def test_lexicon_matches():
    lexicon = Lexicon({"idiot": 4.0, "scum": 4.0, "trash": 3.0, "vorto*": 5.0}, (-3.0, 2.0), 100.0)
    machine = automaton(lexicon)

    def hits(text):
        return density(text, machine, 100.0)[1]

    assert hits("You IDIOT!!") == hits("1d10t") == hits("іdiot") == hits("$cum") == hits("idiot### x") == 1
    assert hits("vortoxyz and vorto") == 2
    assert hits("idiotic") == hits("aidiot") == hits("trash can") == hits("") == 0
    assert hits("trash cannot") == 1
    short, long = density("idiot " + "a " * 50, machine, 100.0)[0], density("idiot " + "a " * 5000, machine, 100.0)[0]
    assert short > 10 * long
    assert len(fold("İIі")) == 3


def test_disguised_words_match():
    words = ("idiot", "moron", "scum", "stupid", "pathetic", "worthless", "clown", "hazy")
    machine = automaton(Lexicon(dict.fromkeys(words, 4.0), (-3.0, 2.0), 100.0))
    plain = "abcdefghijklmnopqrstuvwxyz"
    shifted = lambda first: {c: chr(first + k) for k, c in enumerate(plain)}
    disguises = [
        shifted(0xFF41), shifted(0xFF21), shifted(0x1D41A), shifted(0x1D400), shifted(0x1D5D4),  # fullwidth, mathematical
        dict(zip("abcdehijkmnoprstuwxy", "аьсԁеһіјкмпоргѕтцшху")) | {"u": "υ"},
        dict(zip("abcehijkmoprstxy", "АВСЕНІЈКМОРГЅТХУ")),
        dict(zip("abehiklmnoprtuvwxyz", "ΑΒΕΗΙΚӀΜΝΟΡГΤυνωΧΥΖ")),
        dict(zip("abcdefghijklmnoprstuvwyz", "ᴀʙᴄᴅᴇꜰɢʜɪᴊᴋʟᴍɴᴏᴘʀꜱᴛᴜᴠᴡʏᴢ")),
        *[{c: c + z for c in plain} for z in "\u200b\u200d\u2060\ufeff\u00ad\ufe0f"],
    ]
    for table in disguises:
        for word in words:
            for k in range(len(word)):
                one = word[:k] + table.get(word[k], word[k]) + word[k + 1 :]
                assert density(f"a {one} b", machine, 100.0)[1] == 1, (one, fold(one))
            every = "".join(table.get(c, c) for c in word)
            assert density(f"a {every} b", machine, 100.0)[1] == 1, (every, fold(every))
    assert density("мoronic idiotс", machine, 100.0)[1] == 0
    for c in map(chr, range(0x110000)):
        assert len(fold(c)) == 1 and fold(fold(c)) == fold(c)


def test_toxicity_learns_words_and_families(spark, docs_of, odd_rows):
    rng = random.Random(4)
    rows, marks = [], []
    for i in range(160):
        words = prose(rng, 60).split()
        if i % 4 == 0:
            words[5], words[30] = "zzkrak" if i % 8 else "qqmok" + rng.choice("abcdefgh") * 3, "zzkrak" if i % 8 else "qqmok" + rng.choice("abcdefgh") * 4
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(i % 4 == 0)))
    labels = spark.createDataFrame(marks[:100], "doc_id long, quality int, toxic int")
    lexicon = learn_lexicon(docs_of(rows), labels)
    got = {r.doc_id: r.score for r in score_toxicity(docs_of(rows), lexicon).collect()}
    assert all((got[i] >= 0.3) == bool(t) for i, _, t in marks)
    odd = score_toxicity(docs_of(odd_rows), lexicon).collect()
    assert len(odd) == len(odd_rows) and all(r.score < 0.3 for r in odd)
    assert score_toxicity(docs_of([]), lexicon).count() == 0
    start = learn_lexicon(docs_of(rows), labels.limit(0))
    assert score_toxicity(docs_of([(1, "an idiot and a moron")]), start).first().score > 0.3


def bags(seed, documents=7, width=5):
    rng = np.random.default_rng(seed)
    at = np.append(0, np.cumsum(rng.integers(1, 6, documents)))
    vectors = rng.normal(size=(at[-1], width))
    label = rng.integers(0, 2, documents).astype(float)
    label[:2] = 0, 1
    return vectors, at, label


def test_score_is_the_formula_of_gated_attention():
    vectors, at, label = bags(1)
    model = fit_attention(vectors, at, label, QualityParams(steps=30, hidden=3))
    for i, score in enumerate(model.score(vectors, at)):
        bag = [[max(-6.0, min(6.0, (v - m) / s)) for v, m, s in zip(row, model.mean, model.scale)] for row in vectors[at[i] : at[i + 1]]]
        e = []
        for x in bag:
            hidden = [math.tanh(sum(a * w for a, w in zip(x, model.value[:, j]))) / (1 + math.exp(-sum(a * w for a, w in zip(x, model.gate[:, j])))) for j in range(3)]
            e.append(sum(h * u for h, u in zip(hidden, model.pick)))
        weight = [math.exp(v) / sum(map(math.exp, e)) for v in e]
        z = [sum(a * x[d] for a, x in zip(weight, bag)) for d in range(5)]
        assert score == pytest.approx(1 / (1 + math.exp(-(sum(a * b for a, b in zip(z, model.out)) + model.bias))), abs=1e-12)


def test_gradients_are_those_of_the_loss():
    vectors, at, label = bags(2)
    model = fit_attention(vectors, at, label, QualityParams(steps=5, hidden=3))
    decay = 0.01

    def loss():
        p = model.score(vectors, at)
        squares = sum(float((getattr(model, k) ** 2).sum()) for k in ("value", "gate", "pick", "out"))
        return -float((label * np.log(p) + (1 - label) * np.log(1 - p)).mean()) + decay / 2 * squares

    found = gradients(model, vectors, at, label, decay)
    for name in ("value", "gate", "pick", "out"):
        own = getattr(model, name)
        for index in np.ndindex(own.shape):
            kept = own[index]
            own[index] = kept + 1e-5
            high = loss()
            own[index] = kept - 1e-5
            low = loss()
            own[index] = kept
            assert found[name][index] == pytest.approx((high - low) / 2e-5, abs=1e-6)
    kept = model.bias
    model.bias = kept + 1e-5
    high = loss()
    model.bias = kept - 1e-5
    assert found["bias"] == pytest.approx((high - loss()) / 2e-5, abs=1e-6)


def naive_density(text, lexicon):
    """Every entry at every place, and every phrase against every hit."""
    text = visible(text)
    folded = fold(text)
    starts = lambda i: i == 0 or not text[i - 1].isalnum()
    stops = lambda i: i == len(text) or not text[i].isalnum()
    excused = [(i, i + len(p)) for p in map(fold, EXCEPTIONS) for i in range(len(text)) if folded.startswith(p, i) and starts(i) and stops(i + len(p))]
    best = {}
    for entry, weight in lexicon.weights.items():
        key = fold(entry.rstrip("*"))
        for i in range(len(text)):
            if folded.startswith(key, i) and starts(i) and (entry.endswith("*") or stops(i + len(key))) and not any(s <= i and i + len(key) <= e for s, e in excused):
                best[i] = max(weight, best.get(i, 0.0))
    words = text.count(" ") + text.count("\n") + 1
    return (sum(best.values()) * lexicon.per / max(words, lexicon.per / 4), len(best)) if best else (0.0, 0)


def test_matching_against_brute_force():
    rng = random.Random(6)
    lexicon = Lexicon({"idiot": 4.0, "scum": 4.5, "trash": 3.0, "clown": 3.5, "trashy*": 5.0, "mor*": 3.0, "moron": 6.0, "can": 1.0}, (-3.0, 2.0), 100.0)
    machine = automaton(lexicon)
    parts = ["idiot", "scum", "trash can", "trash", "cans", "circus clown fish", "clown", "fish", "moron", "more", "trashyx", "$cum", "1d1ot", " ", ".", "\u200b", "ѕcum", "x", "!", "\n", "not stupid"]
    for _ in range(600):
        text = "".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 12)))
        got, want = density(text, machine, 100.0), naive_density(text, lexicon)
        assert got[1] == want[1] and got[0] == pytest.approx(want[0]), text


def test_matching_is_linear_in_hits_and_phrases():
    machine = automaton(Lexicon({"trash": 1.0}, (-3.0, 2.0), 100.0))
    began = time.time()
    assert density("trash can " * 160_000, machine, 100.0) == (0.0, 0)  # 1.6 MB
    assert time.time() - began < 30


def test_learnt_weights_are_log_odds(spark, docs_of):
    rng = random.Random(7)
    words = ["vorto", "zork", "blee", "calm", "tree", "house", "river"]
    rows, marks = [], []
    for i in range(200):
        toxic = i % 4 == 0
        own = [rng.choice(words[3:]) for _ in range(20)] + ([rng.choice(words[:3])] if toxic and rng.random() < 0.9 else [])
        rows.append((i, " ".join(own)))
        marks.append((i, int(toxic)))
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    lexicon = learn_lexicon(docs_of(rows), labels)
    toxic, other = sum(t for _, t in marks), sum(1 - t for _, t in marks)
    for word in words:
        holds = [dict(marks)[i] for i, t in rows if word in t.split()]
        weight = math.log((sum(holds) + 0.5) / (toxic + 1)) - math.log((len(holds) - sum(holds) + 1.5) / (other + 1))
        kept = sum(holds) >= ToxicityParams().least_docs and weight >= ToxicityParams().least_weight
        assert lexicon.weights.get(fold(word)) == (pytest.approx(weight) if kept else None)


def test_labels_that_differ_count_as_one(spark, docs_of):
    rows, marks = corpus()
    both = [(i, 0) for i, *_ in marks] + [(i, 1) for i, q, _ in marks if q]
    once = spark.createDataFrame([(i, q) for i, q, _ in marks], "doc_id long, quality int")
    twice = spark.createDataFrame(both, "doc_id long, quality int")
    one, two = train(docs_of(rows), once), train(docs_of(rows), twice)
    assert np.array_equal(one.out, two.out) and one.bias == two.bias
    toxic = [f.withColumnRenamed("quality", "toxic") for f in (once, twice)]
    first, second = (learn_lexicon(docs_of(rows), f) for f in toxic)
    assert first.weights == second.weights and first.curve == second.curve


def test_fit_reads_all_passages_within_its_bound(spark, docs_of):
    rows = [(i, " ".join(["good words" if i % 2 else "BAD!!!", "x" * i] * (40 * (1 + i % 3)))) for i in range(30)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    small = train(docs_of(rows), labels, QualityParams(fit_total=60, steps=20))
    whole = train(docs_of(rows), labels, QualityParams(steps=20))
    assert not np.array_equal(small.mean, whole.mean)
    vectors, _ = passages(next(text_batches(pa.array([t for _, t in rows]))), 64)
    assert np.allclose(whole.mean, vectors.astype(np.float64).mean(axis=0))


def test_queries_hold_out_what_the_contract_says(spark, docs_of, tmp_path):
    rows, marks = corpus()
    docs_of(rows).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for query, parts, held in ((op1_quality, 5, 0), (op6_toxicity, 4, 2)):
        got = query(spark, str(tmp_path)).collect()
        assert sorted(r.doc_id for r in got) == [i for i, _ in rows]
        for r in got:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == held)
            assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
