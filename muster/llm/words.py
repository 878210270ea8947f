"""Vectorised words and shingles of whole text columns.

A word is a longest run of ASCII letters, ASCII digits and characters beyond ASCII, after Unicode
lower-casing. Work goes in slabs of a few MB cut between words, so memory does not follow the longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import bytes_of, mix

SLAB = 1 << 21
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
IS_WORD = np.zeros(256, bool)
IS_WORD[np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", np.uint8)] = True
IS_WORD[128:] = True


def powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _slabs(data: np.ndarray) -> list[tuple[int, int]]:
    cuts, begin = [], 0
    while begin < len(data):
        end = min(len(data), begin + SLAB)
        while end < len(data) and IS_WORD[data[end]] and IS_WORD[data[end - 1]]:  # a word is never cut
            end += 1
        cuts.append((begin, end))
        begin = end
    return cuts


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and each row's bounds among them."""
    data, bounds = bytes_of(pc.utf8_lower(column.fill_null("")) if column.null_count else pc.utf8_lower(column))
    hashes, starts = [], []
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    for begin, end in _slabs(data):
        part = data[begin:end]
        inside = IS_WORD[part]
        before = np.empty_like(inside)
        before[0] = False
        before[1:] = inside[:-1]
        at = np.flatnonzero(inside & (~before | edge[begin:end]))
        if not len(at):
            continue
        # The slab's start is never inside a word of the same row, for slabs are cut between words.
        place = np.arange(len(part), dtype=np.int64) - np.repeat(np.concatenate(([0], at)), np.diff(np.concatenate(([0], at, [len(part)]))))
        value = np.where(inside, part.astype(np.uint64) + np.uint64(1), np.uint64(0))
        hashes.append(mix(np.add.reduceat(value * powers(int(place.max()) + 1)[place], at)))
        starts.append(at + begin)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), bounds).astype(np.int64)


def shingle_sets(column: pa.Array, size: int):
    """For each row the sorted distinct hashes of its word runs of that size; shorter texts have one run of all words, empty ones none."""
    h, bounds = words(column)
    if len(h) >= size:
        run = np.zeros(len(h) - size + 1, np.uint64)
        for k in range(size):
            run = run * BASE + h[k : len(h) - size + 1 + k]
        run = mix(run)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(run[a : b - size + 1])
        elif b > a:
            x = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in h[a:b]:
                    x = x * BASE + w
            yield mix(np.array([x], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
