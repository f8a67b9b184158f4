"""The similarity of texts as difflib has it, of many pairs at once, and a bound on it.

The similarity is twice the characters in matching blocks over the lengths of both texts. Blocks are in one order in
both, so they hold no more than the longest common subsequence: that is the bound, by bits (Hyyro's recurrence).
"""

from __future__ import annotations

import difflib

import numpy as np

#: Longest texts that are worked out side by side; others one by one.
SHORT = 63


def _codes(texts: list[str]) -> np.ndarray:
    width = max(1, max(map(len, texts)))
    return np.array(texts, f"U{width}").view(np.uint32).reshape(len(texts), width)


def _blocks(x: np.ndarray, y: np.ndarray, alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The longest common piece of each x[alo:ahi] and y[blo:bhi], the first in x and then in y: its ends and its size."""
    wide, high = int((ahi - alo).max()), int((bhi - blo).max())
    at = np.arange(len(x))[:, None]
    a, b = (v[at, np.minimum(lo[:, None] + np.arange(w), v.shape[1] - 1)] for v, lo, w in ((x, alo, wide), (y, blo, high)))
    within = np.arange(high) < (bhi - blo)[:, None]
    run = np.zeros((len(x), high + 1), np.int8)
    size, i_end, j_end = (np.zeros(len(x), np.int64) for _ in range(3))
    rows = np.arange(len(x))
    for i in range(wide):
        same = (a[:, i, None] == b) & within & (i < ahi - alo)[:, None]
        run[:, 1:] = (run[:, :-1] + 1) * same
        j = run[:, 1:].argmax(1)
        most = run[rows, j + 1]
        better = most > size
        size[better], i_end[better], j_end[better] = most[better], i + 1, j[better] + 1
    return alo + i_end, blo + j_end, size


def _short_ratios(a: list[str], b: list[str]) -> np.ndarray:
    x, y = _codes(a), _codes(b)
    total = np.zeros(len(a), np.int64)
    n, m = (np.array([len(t) for t in texts]) for texts in (a, b))
    pair, alo, ahi, blo, bhi = np.arange(len(a)), np.zeros_like(n), n, np.zeros_like(m), m
    while True:
        open_ = (alo < ahi) & (blo < bhi)
        pair, alo, ahi, blo, bhi = (v[open_] for v in (pair, alo, ahi, blo, bhi))
        if not len(pair):
            break
        i, j, size = _blocks(x[pair], y[pair], alo, ahi, blo, bhi)
        np.add.at(total, pair, size)
        pair, alo, ahi, blo, bhi = (np.concatenate([u[size > 0], v[size > 0]]) for u, v in ((pair, pair), (alo, i), (i - size, ahi), (blo, j), (j - size, bhi)))
    return np.where(n + m == 0, 1.0, 2.0 * total / np.maximum(n + m, 1))


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """SequenceMatcher(None, a, b).ratio() of each pair."""
    short = np.array([len(x) <= SHORT and len(y) <= SHORT for x, y in zip(a, b, strict=True)], bool)
    out = np.empty(len(a))
    places = np.flatnonzero(short)
    for part in np.split(places, range(4096, len(places), 4096)) if len(places) else []:
        out[part] = _short_ratios([a[k] for k in part], [b[k] for k in part])
    for k in np.flatnonzero(~short):
        out[k] = difflib.SequenceMatcher(None, a[k], b[k]).ratio()
    return out


def bounds(left: list[str], right: list[str]) -> np.ndarray:
    """What the similarity of each left text (rows) to each right one (columns) is at most."""
    ids = {c: k for k, c in enumerate(sorted(set("".join(right))))}
    codes = np.full((len(right), max(1, max(map(len, right)))), len(ids), np.int64)
    for k, t in enumerate(right):
        codes[k, : len(t)] = [ids[c] for c in t]
    shared = np.zeros((len(left), len(right)), np.int64)
    short = [k for k, t in enumerate(left) if len(t) <= SHORT]
    masks = np.zeros((len(short), len(ids) + 1), np.uint64)
    for row, k in enumerate(short):
        for i, c in enumerate(left[k]):
            if c in ids:
                masks[row, ids[c]] |= np.uint64(1 << i)
    open_ = np.full((len(short), len(right)), ~np.uint64(0))
    for j in range(codes.shape[1]):
        met = open_ & masks[:, codes[:, j]]
        open_ = (open_ + met) | (open_ - met)
    own = np.array([(1 << len(left[k])) - 1 for k in short], np.uint64)[:, None]
    shared[short] = np.bitwise_count(~open_ & own)
    for k in set(range(len(left))).difference(short):
        places: dict[str, int] = {}
        for i, c in enumerate(left[k]):
            places[c] = places.get(c, 0) | 1 << i
        every = (1 << len(left[k])) - 1
        for j, t in enumerate(right):
            v = every
            for c in t:
                met = v & places.get(c, 0)
                v = (v + met) | (v - met)
            shared[k, j] = (~v & every).bit_count()
    n = np.array([len(t) for t in left])[:, None] + np.array([len(t) for t in right])
    return np.where(n == 0, 1.0, 2.0 * shared / np.maximum(n, 1))
