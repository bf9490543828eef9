"""BPE encoding and decoding by a transducer with bounded lookahead (operator 13).

Merges run in order of rank, so what follows a text can change how it was merged
only along a chain: a merge over the end of the known part, then one of higher rank
whose right side begins where the first one's left side began, and so on to the left.
`lookahead` finds the longest such chain in a merge list. Whatever comes next, tokens
that end that many symbols before the end of what has been read are final: they are
emitted, and reading goes on from the last of them. What is pending has at most
twice the lookahead, however long the word is. Many words are read in lockstep.

A text is cut at ASCII white space, each distinct piece is normalised and cut into
words as the vocabulary file says and encoded once, and the ids are put back in
order by index arithmetic.

Decoding is a machine that turns ids to bytes and bytes to text: characters leave it
once complete, at most three bytes are held back, and bytes that cannot be a
character become U+FFFD.

Defined cases: NULL text counts as empty; an empty text has no ids and decodes to the
empty text; strings of special tokens are those tokens; ids outside the vocabulary
are skipped in decoding; repeated rows are encoded each; an empty table gives no
rows; columns other than id, text and `keep` are not read. A lone surrogate cannot
occur in a column of strings.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import sys
import types
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wicker.llm.encode import flat_bytes, text_batches

SLICE_BYTES = 4 << 20
CACHE_ENTRIES = 300_000
CACHE_BYTES = 32 << 20
DECODE_IDS = 1 << 16
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_NONE = np.int32(1 << 30)


def byte_letters() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


def lookahead(merges: list[tuple[int, int]], made: list[int], length: list[int]) -> int:
    """Symbols after which a token is final, for merges (left, right) by rank giving `made`; length is in symbols.

    A step of the chain is a merge (u, v) at the end of what is common to all
    continuations, and moves that end back by u. The next step needs a right side that
    begins with u or with the merged token: u lies on the left edge of that token, and
    nothing on that edge above u was made before the step.
    """
    rank = {token: r for r, token in enumerate(made)}
    left: dict[int, int] = {}
    steps: dict[int, tuple[list[int], list[int]]] = {}  # by left side: ranks, and the longest chain up to each
    longest = 0
    for r, ((u, v), token) in enumerate(zip(merges, made)):
        for side in (u, v):
            if rank.get(side, -1) >= r:
                raise ValueError("a merge uses a token that a later merge makes: the list has no bounded lookahead")
        before, edge, limit = 0, v, r - 1
        while True:
            if edge in steps:
                at = bisect_right(steps[edge][0], limit)
                if at:
                    before = max(before, steps[edge][1][at - 1])
            if edge not in left:
                break
            limit, edge = min(limit, rank[edge]), left[edge]
        chain = before + length[u]
        left[token] = u
        ranks, tops = steps.setdefault(u, ([], []))
        ranks.append(r)
        tops.append(max(chain, tops[-1] if tops else 0))
        longest = max(longest, chain)
    return longest


class Transducer:
    """Symbols of many words to tokens, a bounded stretch of each word at a time."""

    def __init__(self, merges: list[tuple[int, int]], made: list[int], length: list[int], window: int | None = None) -> None:
        self.lookahead = lookahead(merges, made, length)
        self.window = max(window or 2 * self.lookahead, self.lookahead + 1)
        self.length = np.array(length, np.int32)
        pairs = np.array(merges, np.int64).reshape(-1, 2)
        names = pairs[:, 0] << 32 | pairs[:, 1]
        order = np.argsort(names)
        if (np.diff(names[order]) == 0).any():
            raise ValueError("a merge is listed twice")
        self.names, self.ranks = names[order], order.astype(np.int32)
        self.made = np.array(made, np.int32)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.names):
            return np.full(len(left), _NONE)
        name = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.names, name), len(self.names) - 1)
        return np.where(self.names[at] == name, self.ranks[at], _NONE)

    def merged(self, tokens: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each owner merged as far as the list goes; owners are ascending numbers."""
        done_tokens, done_owner = [], []
        rank = np.full(len(tokens), _NONE)
        same = owner[:-1] == owner[1:]
        rank[:-1][same] = self._rank(tokens[:-1][same], tokens[1:][same])
        while len(tokens):
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            size = np.diff(np.append(first, len(tokens)))
            best = np.minimum.reduceat(rank, first)
            going = best < _NONE
            if not going.all():
                stay = np.repeat(~going, size)
                done_tokens.append(tokens[stay])
                done_owner.append(owner[stay])
                tokens, owner, rank = tokens[~stay], owner[~stay], rank[~stay]
                if not len(tokens):
                    break
                best, size = best[going], size[going]
            hit = np.flatnonzero(rank == np.repeat(best, size))
            if (np.diff(hit) == 1).any():  # a run of equal tokens: every second pair of it, from the left
                begins = np.flatnonzero(np.append(True, np.diff(hit) != 1))
                place = np.arange(len(hit)) - np.repeat(begins, np.diff(np.append(begins, len(hit))))
                hit = hit[place % 2 == 0]
            tokens[hit] = self.made[rank[hit]]
            keep = np.ones(len(tokens), bool)
            keep[hit + 1] = False
            tokens, owner, rank = tokens[keep], owner[keep], rank[keep]
            at = hit - np.arange(len(hit))  # where the new tokens are now
            stale = np.concatenate((at, at[at > 0] - 1))
            rank[stale] = _NONE
            inside = stale[stale + 1 < len(tokens)]
            inside = inside[owner[inside] == owner[inside + 1]]
            rank[inside] = self._rank(tokens[inside], tokens[inside + 1])
        if not done_tokens:
            return tokens, owner
        tokens, owner = np.concatenate(done_tokens), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return tokens[order], owner[order]

    def encode(self, symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of words given as symbols and n + 1 offsets, with n + 1 offsets into the tokens."""
        words = len(ends) - 1
        at, stop = ends[:-1].copy(), ends[1:]
        out_tokens, out_owner = [], []
        open_words = np.flatnonzero(at < stop)
        while len(open_words):
            begin, end = at[open_words], np.minimum(at[open_words] + self.window, stop[open_words])
            size = end - begin
            owner = np.repeat(open_words, size)
            take = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - begin, size)
            tokens, owner = self.merged(symbols[take].astype(np.int32), owner)
            upto = np.cumsum(self.length[tokens], dtype=np.int64)
            first = np.searchsorted(owner, open_words)
            base = np.where(first > 0, upto[first - 1], 0)
            slot = np.searchsorted(open_words, owner)
            read = upto - base[slot]  # symbols of the stretch up to the end of each token
            last = end == stop[open_words]
            final = last[slot] | (read <= (size - self.lookahead)[slot])
            out_tokens.append(tokens[final])
            out_owner.append(owner[final])
            moved = np.zeros(len(open_words), np.int64)
            np.maximum.at(moved, slot[final], read[final])
            at[open_words] += moved
            if (moved == 0).any():  # a token longer than the rest of the window: wait for more of the word
                self.window *= 2
            open_words = open_words[~last]
        if not out_tokens:
            return np.zeros(0, np.int32), np.zeros(words + 1, np.int64)
        tokens, owner = np.concatenate(out_tokens), np.concatenate(out_owner)
        order = np.argsort(owner, kind="stable")
        return tokens[order], np.append(0, np.cumsum(np.bincount(owner, minlength=words)))


class Codec:
    """Encoder and decoder of a byte-level vocabulary file with word ends.

    Words come from the file's own normaliser and pre-tokenizer; pieces of ASCII take
    a pattern that equals them.
    """

    def __init__(self, path: str, window: int | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, vocabulary = spec["model"], spec["model"]["vocab"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        added = spec["added_tokens"]
        odd += ["added_tokens"] if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) for t in added) else []
        odd += [k for k, v in (("decoder", spec["decoder"]), ("post_processor", spec["post_processor"])) if v]
        if model["type"] != "BPE" or odd:
            raise ValueError(f"not a vocabulary of the kind that this module reads: {model['type']} {odd}")
        suffix = model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.bytes_of = {ord(c): b for b, c in enumerate(letters)}
        self.symbol = np.array([vocabulary[c] for c in letters], np.int32)
        self.end_symbol = np.array([vocabulary[c + suffix] for c in letters], np.int32)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        length = [0] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            length[k] = len(token.removesuffix(suffix)) if suffix else len(token)
        made = [vocabulary[a + b] for a, b in merges]
        self.transducer = Transducer([(vocabulary[a], vocabulary[b]) for a, b in merges], made, length, window)
        self.specials = {t["content"]: t["id"] for t in added}
        longest_first = sorted(self.specials, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if added else None
        whole = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = whole.normalizer, whole.pre_tokenizer
        self.own_pattern = self._pattern(spec)
        strings = {k: t for t, k in vocabulary.items()} | {k: t for t, k in self.specials.items()}
        self.strings = [strings[k].encode() if k in strings else None for k in range(max(strings) + 1)]
        self._forget()

    def _pattern(self, spec: dict) -> re.Pattern | None:
        """The pattern of words for lower-cased pieces of ASCII, if the file cuts words by one."""
        before, steps = spec["pre_tokenizer"], spec["normalizer"] or {"normalizers": []}
        kinds = [s["type"] for s in steps.get("normalizers", [steps])]
        parts = before.get("pretokenizers", []) if before else []
        if kinds != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in parts] != ["Split", "ByteLevel"]:
            return None
        split, last = parts
        if not (split["behavior"] == "Removed" and split["invert"] and "Regex" in split["pattern"]) or last["use_regex"] or last["add_prefix_space"]:
            return None
        text = split["pattern"]["Regex"]
        for name, ascii_part in ((r"[\p{L}]", "[A-Za-z]"), (r"[\p{N}]", "[0-9]"), (r"\p{L}", "A-Za-z"), (r"\p{N}", "0-9")):
            text = text.replace(name, ascii_part)
        return None if r"\p" in text else re.compile(text.encode() + rb"|\n", re.ASCII)

    # encoding

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 20, np.uint32)
        self.first = np.zeros(1 << 18, np.int64)
        self.used = self.key_bytes = 0

    def _one_piece(self, piece: bytes) -> tuple[list[bytes], dict[int, int]]:
        """Words of any piece, and the special tokens in it by number of their (empty) word."""
        words: list[bytes] = []
        specials: dict[int, int] = {}
        for part in self.special.split(piece.decode()) if self.special else [piece.decode()]:
            if part in self.specials:
                specials[len(words)] = self.specials[part]
                words.append(b"")
            elif part:
                part = self.normalizer.normalize_str(part) if self.normalizer else part
                found = self.pre_tokenizer.pre_tokenize_str(part) if self.pre_tokenizer else [(part, None)]
                words += [w.translate(self.bytes_of).encode("latin-1") for w, _ in found if w]
        return words, specials

    def _ascii_pieces(self, pieces: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        """Words of pieces of ASCII without special tokens, and words by piece: one scan over all of them as lines."""
        found = self.own_pattern.findall(b"\n".join(pieces).lower())
        line = np.fromiter((w == b"\n" for w in found), bool, len(found))
        count = np.diff(np.flatnonzero(np.concatenate(([True], line, [True])))) - 1
        return [w for w in found if w != b"\n"], count

    def _other_pieces(self, pieces: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        """The same for pieces beyond ASCII without white space: the library reads many at once, parted by spaces."""
        words: list[bytes] = []
        count = np.zeros(len(pieces), np.int64)
        for at in range(0, len(pieces), 2000):
            text = self.normalizer.normalize_str(b"\n".join(pieces[at : at + 2000]).decode())
            spaces = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), "<u4") == 32)
            found = self.pre_tokenizer.pre_tokenize_str(text)
            words += [w.translate(self.bytes_of).encode("latin-1") for w, _ in found]
            place = np.searchsorted(spaces, np.fromiter((o[0] for _, o in found), np.int64, len(found)))
            count[at : at + 2000] = np.bincount(place, minlength=len(pieces[at : at + 2000]))
        return words, count

    def _words(self, pieces: list[bytes]) -> tuple[list[bytes], np.ndarray, dict[int, int], np.ndarray]:
        """Words of the pieces, words by piece, the special tokens by number of their word, and the order in which the pieces are."""
        kinds: tuple[list[int], list[int], list[int]] = ([], [], [])
        mark = self.special.pattern.encode() if self.special else None
        marked = re.compile(mark).search if mark else None
        for k, piece in enumerate(pieces):
            if not self.own_pattern or marked and marked(piece):
                kinds[2].append(k)
            elif piece.isascii():
                kinds[0].append(k)
            else:
                text = piece.decode()
                kinds[1 if text.split() == [text] else 2].append(k)
        words, counts = [], []
        for which, read in zip(kinds, (self._ascii_pieces, self._other_pieces)):
            if which:
                found, count = read([pieces[k] for k in which])
                words += found
                counts.append(count)
        specials: dict[int, int] = {}
        rest = np.zeros(len(kinds[2]), np.int64)
        for i, k in enumerate(kinds[2]):
            found, own = self._one_piece(pieces[k])
            specials |= {len(words) + n: token for n, token in own.items()}
            words += found
            rest[i] = len(found)
        return words, np.concatenate([*counts, rest]), specials, np.array(kinds[0] + kinds[1] + kinds[2], np.int64)

    def _encode_words(self, words: list[bytes], specials: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.append(0, np.cumsum(size))
        data = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.symbol[data]
        tail = ends[1:][size > 0] - 1
        symbols[tail] = self.end_symbol[data[tail]]
        tokens, at = self.transducer.encode(symbols, ends)
        if specials:
            where = np.array(sorted(specials))
            tokens = np.insert(tokens, at[where], [specials[k] for k in where.tolist()])
            more = np.zeros(len(words), np.int64)
            more[where] = 1
            at = at + np.append(0, np.cumsum(more))
        return tokens, at

    def _slots(self, pieces: list[bytes]) -> np.ndarray:
        """Places of the pieces in the store, encoding those that are new."""
        if len(self.known) > CACHE_ENTRIES or self.key_bytes + 4 * self.used > CACHE_BYTES:
            self._forget()
        new = [p for p in pieces if p not in self.known]
        if new:
            words, count, specials, order = self._words(new)
            new = [new[k] for k in order.tolist()]
            ids, at = self._encode_words(words, specials)
            ends = at[np.append(0, np.cumsum(count))]
            n, used = len(self.known), self.used
            if used + len(ids) > len(self.ids):
                self.ids = np.concatenate((self.ids[:used], np.zeros(used + len(ids), np.uint32)))
            if n + len(new) + 1 > len(self.first):
                self.first = np.concatenate((self.first, np.zeros(len(self.first) + len(new), np.int64)))
            self.ids[used : used + len(ids)] = ids
            self.first[n + 1 : n + 1 + len(new)] = used + ends[1:]
            self.known.update(zip(new, range(n, n + len(new))))
            self.used = used + len(ids)
            self.key_bytes += sum(map(len, new))
        return np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of a slice from text_batches, and n + 1 offsets into them."""
        data, ends = flat_bytes(column)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(column) + 1, np.int64)
        inside = ~_SPACE[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edge = ends[:-1][np.diff(ends) > 0]
        first[edge] = inside[edge]
        last[edge[1:] - 1] = inside[edge[1:] - 1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(column) + 1, np.int64)
        # pieces are what lies between the gaps: offsets alternate between pieces and gaps
        bounds = np.stack((start, end), axis=1).ravel().astype(np.int32)
        spans = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
        coded = spans.take(pa.array(np.arange(0, len(bounds) - 1, 2))).dictionary_encode()
        slot = self._slots(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        begin = self.first[slot]
        each = self.first[slot + 1] - begin
        upto = np.append(0, np.cumsum(each))
        take = np.repeat(begin - upto[:-1], each) + np.arange(upto[-1])
        return self.ids[take], upto[np.searchsorted(start, ends)]

    # decoding

    def text_machine(self) -> TextMachine:
        return TextMachine(self.strings)


class TextMachine:
    """Ids in, text out, as far as characters are complete; tokens are parted by one space."""

    def __init__(self, strings: list[bytes | None]) -> None:
        self.strings = strings
        self.reset()

    def reset(self) -> None:
        self.bytes = codecs.getincrementaldecoder("utf-8")("replace")
        self.begun = False

    def feed(self, ids: Iterable[int]) -> str:
        known = [s for s in (self.strings[k] if k < len(self.strings) else None for k in ids) if s is not None]
        if not known:
            return ""
        parted = b"\x20".join(known)
        text = self.bytes.decode(b"\x20" + parted if self.begun else parted)
        self.begun = True
        return text

    def finish(self) -> str:
        text = self.bytes.decode(b"", True)
        self.reset()
        return text


def worker_codec(path: str) -> Codec:
    """The codec of this worker process: its later tasks know what it has encoded."""
    kept = sys.modules.setdefault("_kept_codecs", types.ModuleType("_kept_codecs")).__dict__
    if path not in kept:
        kept[path] = Codec(path)
    return kept[path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, n_tokens, ids): ids are little-endian unsigned 32-bit integers."""
    rows = docs.select(F.col(id_col).alias("doc_id"), *[F.col(c) for c in keep], F.col(text_col).alias("__text"))
    own = ["doc_id", *keep]
    out = rows.select(*own).withColumns({"n_tokens": F.lit(0).cast("long"), "ids": F.lit(b"")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(path)
        for batch in batches:
            at = 0
            for texts in text_batches(batch.column("__text"), SLICE_BYTES):
                n = len(texts)
                ids, ends = codec.encode(texts)
                cells = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(at, n) for c in own], pa.array(np.diff(ends), pa.int64()), cells], [*own, "n_tokens", "ids"])
                at += n

    return rows.mapInArrow(run, out)


def decode_documents(encoded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """(*keep, text) from a column of little-endian unsigned 32-bit ids; NULL ids decode to the empty text."""
    rows = encoded.select(*[F.col(c) for c in keep], F.col(ids_col).alias("__ids"))
    out = rows.select(*keep).withColumn(text_col, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = worker_codec(path).text_machine()
        for batch in batches:
            texts, size, at = [], 0, 0
            for i, cell in enumerate(batch.column("__ids")):
                ids = np.frombuffer(cell.as_buffer() or b"", "<u4") if cell.is_valid else np.zeros(0, "<u4")
                parts = [machine.feed(ids[k : k + DECODE_IDS].tolist()) for k in range(0, len(ids), DECODE_IDS)]
                texts.append("".join([*parts, machine.finish()]))
                size += len(texts[-1])
                if size > SLICE_BYTES:
                    yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(at, len(texts)) for c in keep], pa.array(texts, pa.string())], [*keep, text_col])
                    texts, size, at = [], 0, i + 1
            if texts:
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(at, len(texts)) for c in keep], pa.array(texts, pa.string())], [*keep, text_col])

    return rows.mapInArrow(run, out)
