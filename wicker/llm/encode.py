"""Token ids of whole texts, a column batch at a time.

The pre-tokenizer of the byte-level vocabularies never joins text over certain
places: before a single white-space character that is followed by other text,
after a line break, and between an ASCII letter and ASCII punctuation. A batch
is cut at these places, each distinct piece is encoded once by the tokenizers
library, and the ids are put back in order by index arithmetic. The result
equals encoding each text whole; a text that contains the string of a special
token goes to the library uncut.
"""

from __future__ import annotations

import os
import re
import sys
import types
from collections.abc import Iterator
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BATCH_BYTES = 8 << 20
CACHE_ENTRIES = 1_000_000
CACHE_BYTES = 16 << 20  # of pieces; the store takes about ten times that


def default_tokenizer() -> str:
    """Path of the vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def word_tokenizer() -> str:
    """Path of the vocabulary with word ends."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    code = np.arange(256)
    letter = ((code >= 65) & (code <= 90)) | ((code >= 97) & (code <= 122))
    digit = (code >= 48) & (code <= 57)
    punct = (code > 32) & (code < 127) & ~letter & ~digit
    # first bytes of characters that are not white space: the white space beyond
    # ASCII starts with C2, E1, E2 or E3
    lead = (code >= 0xC3) & ~np.isin(code, (0xE1, 0xE2, 0xE3))
    return letter, punct, letter | digit | punct | lead


_LETTER, _PUNCT, _SOLID = _tables()
# one space at most, then neither ASCII white space and control characters nor the first byte of what may be white space
# beyond ASCII
_PLAIN = re.compile(rb"\x20?[^\x00-\x20\xc2\xe1\xe2\xe3]+")


def text_batches(column: pa.Array, limit: int = BATCH_BYTES, most: int | None = None) -> Iterator[pa.Array]:
    """Slices of a string column of about `limit` bytes and at most `most` texts; a longer text is one slice. NULL becomes ''."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1)
        to = min(to, at + most) if most else to
        yield column.slice(at, to - at)
        at = to


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_string slice, and where each text starts and the last ends."""
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or ends[-1] == ends[0]:
        return np.zeros(0, np.uint8), ends - ends[0]
    return np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def worker_encoder(path: str, specials_as_text: bool = False) -> Encoder:
    """The encoder of this worker process: what it has encoded is known to its later tasks too."""
    kept = sys.modules.setdefault("_kept_encoders", types.ModuleType("_kept_encoders")).__dict__
    name = (path, specials_as_text)
    if name not in kept:
        kept[name] = Encoder(path, specials_as_text)
    return kept[name]


class Encoder:
    """Encodes string columns; `specials_as_text` reads special strings as ordinary text."""

    def __init__(self, path: str, specials_as_text: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = specials_as_text
        self.specials = [] if specials_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        before = self.tokenizer.pre_tokenizer
        line = self.whole("\n")
        # other kinds of vocabularies may join over the cuts: they get whole texts
        self.cuts = isinstance(before, ByteLevel) and not before.add_prefix_space and self.tokenizer.normalizer is None and len(line) == 1
        self.line = line[0] if line else -1
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 20, np.uint32)
        self.first = np.zeros(1 << 18, np.int64)
        self.used = self.piece_bytes = 0

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _add(self, words: list[bytes], ids: np.ndarray, ends: np.ndarray) -> None:
        n, at = len(self.known), self.used
        if at + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(len(self.ids) + len(ids), np.uint32)))
        if n + len(words) + 1 > len(self.first):
            self.first = np.concatenate((self.first, np.zeros(len(self.first) + len(words), np.int64)))
        self.ids[at : at + len(ids)] = ids
        self.first[n + 1 : n + 1 + len(words)] = at + ends
        self.known.update(zip(words, range(n, n + len(words))))
        self.used = at + len(ids)
        self.piece_bytes += sum(map(len, words))

    def _slots(self, words: list[bytes]) -> np.ndarray:
        """Places of the pieces in the store, encoding those that are new."""
        if len(self.known) > CACHE_ENTRIES or self.piece_bytes > CACHE_BYTES:
            self._forget()
        known = self.known
        new = [w for w in words if w not in known]
        plain = [w for w in new if _PLAIN.fullmatch(w)]
        # pieces without inner white space are encoded as lines of one text: a line break is a token of its own
        for at in range(0, len(plain), 20_000):
            part = plain[at : at + 20_000]
            found = self.tokenizer.encode_batch_fast([b"\n".join(part).decode()], add_special_tokens=False)[0]
            ids = np.array(found.ids, np.uint32)
            breaks = np.flatnonzero(ids == self.line)
            self._add(part, np.delete(ids, breaks), np.append(breaks - np.arange(len(breaks)), len(ids) - len(breaks)))
        for w in new:
            if w not in known:
                ids = self.whole(w.decode())
                self._add([w], np.array(ids, np.uint32), np.array([len(ids)]))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order (uint32), and n + 1 offsets into them."""
        texts = len(column)
        odd = np.zeros(texts, bool)
        if not self.cuts:
            return self._joined([np.asarray(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(column.to_pylist(), add_special_tokens=False)])
        for s in self.specials:
            odd |= pc.match_substring(column, s).to_numpy(zero_copy_only=False)
        if odd.any():
            return self._with_specials(column, odd)
        data, ends = flat_bytes(column)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(texts + 1, np.int64)
        cut = np.zeros(len(data), bool)
        solid, space = _SOLID[data], (data == 32) | (data == 10)
        cut[1:-1] = space[1:-1] & solid[2:]
        cut[1:] |= (data[:-1] == 10) & solid[1:]
        cut[1:] |= _LETTER[data[:-1]] & _PUNCT[data[1:]]
        filled = np.diff(ends) > 0
        cut[ends[1:][filled] - 1] = False  # what follows the last byte belongs to the next text
        cut[ends[:-1][filled]] = True
        starts = np.flatnonzero(cut)
        bounds = np.append(starts, len(data)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        coded = words.dictionary_encode()
        which = coded.indices.to_numpy()
        slot = self._slots(coded.dictionary.to_pylist())[which]
        first = self.first[slot]
        each = self.first[slot + 1] - first
        upto = np.concatenate(([0], np.cumsum(each)))
        take = np.repeat(first - upto[:-1], each) + np.arange(upto[-1])
        return self.ids[take], upto[np.searchsorted(starts, ends)]

    def _with_specials(self, column: pa.Array, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        plain = pc.if_else(pa.array(odd), pa.scalar("", pa.large_string()), column)
        ids, at = self.encode(plain)
        parts = [
            np.asarray(self.whole(column[i].as_py()), np.uint32) if odd[i] else ids[at[i] : at[i + 1]]
            for i in range(len(column))
        ]
        return self._joined(parts)

    @staticmethod
    def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([np.zeros(0, np.uint32), *parts]), np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64)))

    def with_end(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As encode, with an end id after each text."""
        ids, at = self.encode(column)
        texts = len(column)
        out = np.full(len(ids) + texts, end_id, np.uint32)
        keep = np.ones(len(out), bool)
        moved = at + np.arange(texts + 1)
        keep[moved[1:] - 1] = False
        out[keep] = ids
        return out, moved
