"""DartMinHash: sketches of weighted sets.

Each element owns a plane of weight times rank, and a hash throws darts on it
with density one. A dart counts for a set when its weight lies under the
element's weight there. Of the darts of all elements that fall on a coordinate,
the one of least rank is the sketch's entry. Two sets agree in a coordinate with
probability sum(min) / sum(max) of their weights.

Only darts of rank under t / (sum of weights) are thrown, about t = k ln k + 2k
for each set whatever its size; sets with a coordinate left empty throw again
beyond that rank, so the sketch is that of all darts. The plane is cut into
regions doubling in weight and in rank, and each region with an expectation over
one is cut again along the weight.
"""

from __future__ import annotations

import math

import numpy as np

from wicker.llm.words import U, mix

_LOW = 2.0**-2  # the first rank region
_UNIT = 2.0**-53


def _uniform(x: np.ndarray) -> np.ndarray:
    return (x >> U(11)).astype(np.float64) * _UNIT


def _counts(mean: float, u: np.ndarray) -> np.ndarray:
    """Poisson numbers by inversion."""
    p = total = math.exp(-mean)
    steps = []
    for k in range(1, 24):
        steps.append(total)
        p *= mean / k
        total += p
    return np.searchsorted(np.array(steps), u, side="right")


def sketch(code: np.ndarray, owner: np.ndarray, weight: np.ndarray, sets: int, k: int, seed: int = 7) -> np.ndarray:
    """Entries (sets x k, uint64) from elements given as hash, set number and weight > 0.

    An entry is the rank (upper 34 bits) and the name (lower 30) of the dart; a
    set without elements has the largest number everywhere.
    """
    none = U(0xFFFFFFFFFFFFFFFF)
    out = np.full(sets * k, none, U)
    if not len(code):
        return out.reshape(sets, k)
    weight = weight.astype(np.float64)
    sums = np.bincount(owner, weights=weight, minlength=sets)
    upto = (k * math.log(k) + 2 * k) / np.maximum(sums, 1e-300)
    low = np.zeros(sets)
    active = sums > 0
    while active.any():
        mine = active[owner]
        _throw(code[mine], owner[mine], weight[mine], low, upto, k, seed, out)
        active &= (out.reshape(sets, k) == none).any(axis=1)
        low, upto = upto, upto * 2
    return out.reshape(sets, k)


def _throw(code, owner, weight, low, upto, k, seed, out) -> None:
    """Throw the darts with low <= rank < upto of each element's set."""
    most, nu = weight.max(), 0
    while 2.0**nu - 1 < most:
        base, height = 2.0**nu - 1, 2.0**nu
        high = weight > base
        c, o, w = code[high], owner[high], weight[high]
        rho, rank0, width = 0, 0.0, _LOW
        while len(c):
            reach = upto[o] > rank0
            c, o, w = c[reach], o[reach], w[reach]
            use = low[o] < rank0 + width
            if use.any():
                _region(c[use], o[use], w[use], base, height, rank0, width, (nu << 8) | rho, low, upto, k, seed, out)
            rank0, width, rho = rank0 + width, max(width, rank0 + width), rho + 1
        nu += 1


def _region(c, o, w, base, height, rank0, width, name, low, upto, k, seed, out) -> None:
    pieces = max(1, math.ceil(height * width))
    step = height / pieces
    cell = mix(c + U((seed * 0x9E3779B97F4A7C15 + name * 0xC2B2AE3D27D4EB4F) & (2**64 - 1)))
    floor = np.full(len(c), base)
    if pieces > 1:  # only pieces that begin under the weight
        many = np.minimum(pieces, np.ceil((w - base) / step).astype(np.int64))
        part = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        cell, o, w = np.repeat(cell, many), np.repeat(o, many), np.repeat(w, many)
        cell = mix(cell + part.astype(U) * U(0x9FB21C651E98DF25))
        floor = base + part * step
    thrown = _counts(step * width, _uniform(cell))
    some = thrown > 0
    thrown = thrown[some]
    if not len(thrown):
        return
    number = np.arange(thrown.sum()) - np.repeat(np.cumsum(thrown) - thrown, thrown)
    cell, o, w, floor = (np.repeat(x[some], thrown) for x in (cell, o, w, floor))
    dart = mix(cell + (number.astype(U) + U(1)) * U(0xD6E8FEB86659FD93))
    rank = rank0 + _uniform(dart) * width
    second = mix(dart + U(0xA0761D6478BD642F))
    hit = (floor + _uniform(second) * step < w) & (rank >= low[o]) & (rank < upto[o])
    dart, rank, o = second[hit], rank[hit], o[hit]
    third = mix(dart + U(0xE7037ED1A0B428DB))
    coordinate = (third >> U(33)).astype(np.int64) % k
    entry = (np.minimum(rank * 2.0**22, 2.0**34 - 1).astype(U) << U(30)) | (third & U((1 << 30) - 1))
    np.minimum.at(out, o * k + coordinate, entry)


def bands(entries: np.ndarray, count: int, rows: int) -> np.ndarray:
    """One 64-bit number for each band of `rows` entries (sets x count)."""
    sets = len(entries)
    out = np.repeat(mix(np.arange(count, dtype=U) + U(11))[None, :], sets, axis=0)
    cut = entries[:, : count * rows].reshape(sets, count, rows)
    for r in range(rows):
        out = mix(out * U(0xFF51AFD7ED558CCD) + cut[:, :, r])
    return out
