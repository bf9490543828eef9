import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from wicker.llm.bpe import Codec, TextMachine, Transducer, decode_documents, encode_documents, lookahead
from wicker.llm.encode import text_batches, word_tokenizer
from wicker.llm.queries import op13_bpe_codec

PARTS = "aeiounstrhl'’ .,\n\t<|>0123ÉéßŒ̧́İΣς漢字🙂‍  \x1c\x85\x00٣²ⅷ"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(word_tokenizer())


@pytest.fixture(scope="module")
def codec():
    return Codec(word_tokenizer())


def differing(codec, library, texts):
    bad = []
    for part in text_batches(pa.array(texts, pa.large_string())):
        ids, at = codec.encode(part)
        machine = codec.text_machine()
        for i, found in enumerate(library.encode_batch(part.to_pylist(), add_special_tokens=False)):
            got = ids[at[i] : at[i + 1]].tolist()
            if got != found.ids or machine.feed(got) + machine.finish() != library.decode(found.ids, skip_special_tokens=False):
                bad.append(part[i].as_py())
    return bad


def test_random_texts_equal_the_library(codec, library):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["a<|endoftext|>B é<|endoftext|>ß", "<|startoftext|><|endoftext|>", "<|endoftext", "", "   ", "don't WE'LL 'S 's"]
    assert differing(codec, library, texts) == []


def test_long_words_equal_the_library_with_small_windows(library):
    rng = random.Random(7)
    small = Codec(word_tokenizer(), window=1)  # the least that the lookahead allows
    assert small.transducer.window == small.transducer.lookahead + 1
    near = [small.transducer.lookahead + k for k in (-1, 0, 1, 2)]
    texts = ["".join(rng.choice("thesandingrion") for _ in range(n)) for n in [*near, *near, 2 * near[0], 1000, 5000]]
    texts += ["a" * 3000, "ab" * 2000, "é" * 1500, "!" * 2000, "ha" * 1000 + "!", "z" * 145 + "the"]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(150, 1500))) for _ in range(60)]
    assert differing(small, library, texts) == []


def naive(symbols, ranks):
    while True:
        found = [(ranks[p][0], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]
        if not found:
            return symbols
        _, i = min(found)
        symbols = [*symbols[:i], ranks[symbols[i], symbols[i + 1]][1], *symbols[i + 2 :]]


def test_random_merge_lists_against_naive_merging():
    rng = random.Random(11)
    for _ in range(40):
        letters = rng.randint(2, 4)
        length, merges, made = [1] * letters, [], []
        for _ in range(rng.randint(1, 14)):
            pair = (rng.randrange(len(length)), rng.randrange(len(length)))
            if pair not in merges:
                merges.append(pair)
                made.append(len(length))
                length.append(length[pair[0]] + length[pair[1]])
        ranks = {p: (r, made[r]) for r, p in enumerate(merges)}
        machine = Transducer(merges, made, length, window=1)
        words = [[rng.randrange(letters) for _ in range(rng.randint(0, 60))] for _ in range(40)]
        tokens, at = machine.encode(np.array([s for w in words for s in w], np.int32), np.append(0, np.cumsum([len(w) for w in words])).astype(np.int64))
        assert [tokens[s:e].tolist() for s, e in zip(at, at[1:])] == [naive(w, ranks) for w in words]


def test_lookahead_by_hand():
    # ab before bc: what follows c cannot matter, but c decides nothing either; bc before ab: one letter b may be taken from a
    assert lookahead([(0, 1), (1, 2)], [3, 4], [1, 1, 1, 2, 2]) == 1
    assert lookahead([(1, 2), (0, 1)], [3, 4], [1, 1, 1, 2, 2]) == 2
    with pytest.raises(ValueError):
        lookahead([(0, 3), (0, 1)], [4, 3], [1, 1, 1, 2, 3])


def test_text_machine_holds_back_incomplete_characters():
    machine = TextMachine(["a".encode(), b"\xe6", b"\xbc\xa2", b"\xff"])
    assert machine.feed([0, 0]) == "a a"
    assert machine.finish() == ""
    assert machine.feed([9, 1]) == "" and machine.finish() == "�"
    assert machine.feed([3]) == "�"


def test_rows_of_the_operator(spark, docs_of, odd_rows, library, rows):
    encoded = encode_documents(docs_of(odd_rows), word_tokenizer())
    decoded = decode_documents(encoded, word_tokenizer(), keep=("doc_id", "n_tokens"))
    want = []
    for i, text in odd_rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), library.decode(ids, skip_special_tokens=False)))
    assert rows(decoded, "doc_id", "n_tokens", "text") == sorted(want, key=repr)
    assert encode_documents(docs_of([]), word_tokenizer()).count() == 0
    nulls = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert rows(decode_documents(nulls, word_tokenizer()), "doc_id", "text") == [(1, "")]


def test_query_against_the_library(spark, docs_of, odd_rows, library, rows, tmp_path):
    docs_of(odd_rows).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, text in odd_rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    found = op13_bpe_codec(spark, str(tmp_path))
    assert rows(found, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
