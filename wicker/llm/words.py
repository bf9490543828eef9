"""Words and word hashes of text batches, as arrays.

A word is a run of ASCII letters, ASCII digits and characters beyond ASCII, in
lower case. Hashes are 64-bit: a sum of random byte codes times powers of an odd
base, mixed, so all words of a batch are hashed at once from one prefix sum.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from wicker.llm.encode import flat_bytes

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_CODES = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)
_code = np.arange(256)
_IN_WORD = ((_code >= 48) & (_code <= 57)) | ((_code >= 97) & (_code <= 122)) | ((_code >= 65) & (_code <= 90)) | (_code >= 128)
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash: every input bit changes every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _power(count: int) -> list[np.ndarray]:
    if len(_powers[0]) < count:
        size = 1 << count.bit_length()
        for k, base in enumerate((_BASE, _BACK)):
            steps = np.full(size, base, U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U)
    return _powers


@dataclass
class Words:
    """Words of a batch: byte bounds, hashes, and for each text where its words begin (n + 1 numbers)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    upto: np.ndarray


def words_of(column: pa.Array) -> Words:
    """All words of a slice from text_batches."""
    data, ends = flat_bytes(pc.utf8_lower(column))
    texts = len(column)
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, none.astype(U), np.zeros(texts + 1, np.int64))
    inside = _IN_WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = ends[:-1][np.diff(ends) > 0]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edge[1:] - 1] = inside[edge[1:] - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power(len(data) + 1)
    total = np.concatenate((np.zeros(1, U), np.cumsum(_CODES[data] * up[: len(data)], dtype=U)))
    code = mix((total[end] - total[start]) * down[start] + (end - start).astype(U))
    return Words(data, start, end, code, np.searchsorted(start, ends))


def shingles_of(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of `size` words and the text it is in, in order; a shorter text with words has one run of all its words."""
    texts = len(words.upto) - 1
    many = np.diff(words.upto)
    text = np.repeat(np.arange(texts), many)
    code = words.hash
    n = len(code)
    if n == 0:
        return code, text
    left = words.upto[1:][text] - np.arange(n)  # words from here to the end of the text
    out = np.zeros(n, U)
    for k in range(size):
        step = np.zeros(n, U)
        step[: max(0, n - k)] = code[k:]
        step[left <= k] = 0
        out = (out ^ step) * U(0xFF51AFD7ED558CCD) + U(k + 1)
        out ^= out >> U(32)
    keep = (left >= size) | (words.upto[:-1][text] == np.arange(n)) & (many[text] < size)
    return mix(out[keep]), text[keep]


def counted(code: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, code) pairs in some order, with how often each occurs."""
    if not len(code):
        return code, text, np.zeros(0, np.int64)
    both = code ^ (text.astype(U) + U(1)) * U(0xD6E8FEB86659FD93)
    order = np.argsort(both)
    both = both[order]
    at = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
    first = order[at]
    return code[first], text[first], np.diff(np.append(at, len(both)))
