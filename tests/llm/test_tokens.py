import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from wicker.llm.encode import Encoder, default_tokenizer, text_batches
from wicker.llm.packing import TightestRoom, encode_pieces, pack, plan, sequences
from wicker.llm.token_counts import length_counts, length_histogram, quantile_length
from wicker.llm.token_files import open_corpus, read_documents, write_token_files


@pytest.fixture(scope="module")
def encoder():
    return Encoder(default_tokenizer())


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoding_equals_the_library(encoder):
    random.seed(3)
    parts = ["a", "b", " ", "\n", "\t", "é", " ", "　", "1", ".", "'s", "!", "<|endoftext|>", "\r", "ß", "日", " the", " \n", " ", "\x1c"]
    for _ in range(150):
        texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 30))) for _ in range(20)]
        ids, at = encoder.encode(next(text_batches(pa.array(texts))))
        assert [list(ids[s:e]) for s, e in zip(at, at[1:])] == [encoder.whole(t) for t in texts]


def test_specials_as_text(encoder):
    plain = Encoder(default_tokenizer(), specials_as_text=True)
    ids, _ = plain.encode(next(text_batches(pa.array(["a <|endoftext|> b"]))))
    assert 50256 not in ids and 50256 in encoder.whole("a <|endoftext|> b")


def test_token_files_round_trip(spark, docs_of, odd_rows, encoder, tmp_path):
    path = f"file://{tmp_path}/corpus"
    write_token_files(docs_of(odd_rows), path, default_tokenizer(), shards=3)
    got = read_documents(spark, open_corpus(spark, path), with_ids=True).collect()
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, 1, 2, 3, 5, 7, 9, 9, 9, 11]
    at = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), crc(r.ids)) and r.ids[-1] == 0
        at += r.n_tokens
    want = sorted([*encoder.whole(t or ""), 0] for _, t in odd_rows)
    assert sorted(list(r.ids) for r in got) == want


def test_token_files_of_nothing(spark, docs_of, tmp_path):
    corpus = write_token_files(docs_of([]), f"{tmp_path}/none", default_tokenizer(), shards=2)
    assert read_documents(spark, corpus).collect() == []


def one_by_one(lengths, capacity):
    rooms = []
    for length in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= length]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - length)
        else:
            rooms.append(capacity - length)
    return sorted(rooms)


def test_plan_is_best_fit_decreasing():
    rng = np.random.default_rng(0)
    for capacity, top in ((10, 10), (64, 40), (64, 9), (100, 100)):
        for _ in range(25):
            lengths = rng.integers(1, top + 1, rng.integers(1, 120)).tolist()
            counts = {n: lengths.count(n) for n in set(lengths)}
            events, total = plan(counts, capacity)
            used = [0] * total
            for length, first, last, base, per, place in sorted(events, key=lambda e: (-e[0], e[1])):
                for k in range(first, last):
                    s = base + (k - first) // per
                    assert used[s] == place + (k - first) % per * length
                    used[s] += length
            assert sorted(capacity - u for u in used) == one_by_one(lengths, capacity)


def test_segment_tree():
    tree = TightestRoom(20)
    assert tree.find(0) is None
    for room in (3, 9, 20):
        tree.add(room, 1)
    assert [tree.find(k) for k in (0, 3, 4, 10, 20)] == [3, 3, 9, 20, 20]
    tree.add(9, -1)
    assert tree.find(4) == 20


def test_packing(spark, docs_of, odd_rows, encoder):
    rows = pack(docs_of(odd_rows), default_tokenizer(), 64).collect()
    held = {}
    for r in rows:
        assert len(r.ids) == 4 * r.length <= 256
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert len(held) == len(one_by_one([r.length for r in rows], 64))
    long = sorted((r for r in rows if r.doc_id == 1), key=lambda r: r.piece)
    ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in long])
    assert ids.tolist() == [*encoder.whole(odd_rows[9][1]), 0]
    assert all(r.length == 64 for r in long[1:]) and [r.start for r in long] == np.cumsum([0, *[r.length for r in long[:-1]]]).tolist()
    assert sequences(pack(docs_of(odd_rows), default_tokenizer(), 64)).count() == len(held)
    assert pack(docs_of([]), default_tokenizer()).count() == 0
    assert encode_pieces(docs_of([(1, None)]), default_tokenizer()).first().length == 1


def test_length_histogram(docs_of, odd_rows, encoder):
    got = length_histogram(length_counts(docs_of(odd_rows), default_tokenizer()))
    lengths = np.array([len(encoder.whole(t or "")) for _, t in odd_rows])
    for r in got.collect():
        over = lengths[lengths > r.length]
        assert (r.docs, r.docs_over, r.tokens_over) == ((lengths == r.length).sum(), len(over), over.sum())
        assert r.tokens_cut == np.minimum(lengths, r.length).sum() and r.tokens_all == lengths.sum()
    assert quantile_length(got, 0.5).first().length == sorted(lengths)[(len(lengths) + 1) // 2 - 1]
    assert length_histogram(length_counts(docs_of([]), default_tokenizer())).count() == 0
