"""Benchmark decontamination by the q-gram lemma.

An occurrence of an item of n characters with at most k edits shares at least n - q + 1 - k * q q-grams with it, on diagonals that
lie within k of one another. Shared q-grams are counted in bands of 2 * (k + 1) diagonals that overlap by half, so one band holds
them all; regions that meet the bound are kept and verified by alignment within that band. Items of fewer than q characters are
looked up as whole words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trimmed

Q, RATE = 8, 0.1
BLOCK_BYTES = 4 << 20
PIECE, HITS = 1 << 20, 4 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
GAP = 1  # between texts; no item holds it
_ALNUM: list[np.ndarray] = []


def _alnum() -> np.ndarray:
    if not _ALNUM:
        _ALNUM.append(np.array([chr(c).isalnum() for c in range(0x110000)]))
    return _ALNUM[0]


def normalised(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a text in lower case with one space for each run that is neither letter nor digit, and where each was."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    own = _alnum()[codes]
    keep = own.copy()
    keep[1:] |= ~own[1:] & own[:-1]
    at = np.flatnonzero(keep)
    return np.where(own, codes, 32)[at], at


def _hashes(codes: np.ndarray) -> np.ndarray:
    n = max(0, len(codes) - Q + 1)
    if not n:
        return np.zeros(0, np.uint64)
    out, size, power = codes.astype(np.uint64), 1, BASE
    with np.errstate(over="ignore"):
        while size < Q:  # Q is a power of two
            out = out[:-size] * power + out[size:]
            size, power = size * 2, power * power
    return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


class Items:
    """A block of benchmark items and their q-gram postings."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.ids, self.codes, self.edits, self.bound = [], [], [], []
        self.short: dict[bytes, list[int]] = {}  # items without a q-gram
        for item_id, text in items:
            codes = normalised(text or "")[0]
            if len(codes) and codes[-1] == 32:
                codes = codes[:-1]
            if len(codes) < Q:
                if len(codes):
                    self.short.setdefault(codes.tobytes(), []).append(item_id)
                continue
            k = min(int(rate * len(codes)), (len(codes) - Q) // Q)
            self.ids.append(item_id)
            self.codes.append(codes)
            self.edits.append(k)
            self.bound.append(len(codes) - Q + 1 - k * Q)
        hashes = [_hashes(c) for c in self.codes]
        flat = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        order = np.argsort(flat, kind="stable")
        self.grams, self.first = np.unique(flat[order], return_index=True)
        self.first = np.append(self.first, len(flat))
        self.item = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])[order]
        self.offset = np.concatenate([*(np.arange(len(h)) for h in hashes), np.zeros(0, np.int64)])[order].astype(np.int64)
        self.edits, self.bound = np.array(self.edits, np.int64), np.array(self.bound, np.int64)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.grams >> np.uint64(44)).astype(np.int64)] = True

    def regions(self, codes: np.ndarray):
        """(item, least diagonal, end of diagonals) of each region that meets the bound."""
        h = _hashes(codes)
        at = np.flatnonzero(self.seen[(h >> np.uint64(44)).astype(np.int64)])
        if not len(at) or not len(self.grams):
            return np.zeros((0, 3), np.int64)
        place = np.minimum(np.searchsorted(self.grams, h[at]), len(self.grams) - 1)
        real = self.grams[place] == h[at]
        at, place = at[real], place[real]
        count = self.first[place + 1] - self.first[place]
        end = np.cumsum(count)
        shift = int(max(map(len, self.codes))) + 1
        span = len(codes) + 2 * shift + 2
        mask = (1 << 21) - 1

        def hits(begin: int, stop: int):
            """(offset, cell, bound) of the hits of some places: items that share a template have many."""
            n = count[begin:stop]
            to = np.cumsum(n)
            posting = np.repeat(self.first[place[begin:stop]] - (to - n), n) + np.arange(to[-1])
            item, offset = self.item[posting], self.offset[posting]
            return offset, item * span + (np.repeat(at[begin:stop], n) - offset + shift) // (self.edits[item] + 1), self.bound[item]

        cuts = [0]
        while cuts[-1] < len(at):
            done = end[cuts[-1] - 1] if cuts[-1] else 0
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(end, done + HITS, side="right"))))
        parts = list(zip(cuts[:-1], cuts[1:], strict=True))
        # First an upper bound of each hit's bands, from counters that others may share.
        shared = np.zeros(mask + 1, np.int64)
        kept = [hits(*part) for part in parts] if len(parts) == 1 else None
        for k, part in enumerate(parts):
            shared += np.bincount((kept[k] if kept else hits(*part))[1] & mask, minlength=mask + 1)
        offset, cell = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, part in enumerate(parts):
            o, c, bound = kept[k] if kept else hits(*part)
            near = shared[c & mask] + np.maximum(shared[(c + 1) & mask], shared[(c - 1) & mask]) >= bound
            offset.append(o[near])
            cell.append(c[near])
        offset, cell = np.concatenate(offset), np.concatenate(cell)
        # An item's q-gram counts once in a half band, however often the text repeats it there.
        most = shift + 1
        key, hits = np.unique(np.unique(cell * most + offset) // most, return_counts=True)
        # Each half band with the next: hits of the two together, and of a last one alone.
        after = np.zeros(len(key), np.int64)
        near = np.flatnonzero(key[1:] == key[:-1] + 1)
        after[near] = hits[near + 1]
        before = np.zeros(len(key), bool)
        before[near + 1] = True
        item, band = key // span, key % span
        enough = hits + after >= self.bound[item]
        item, band = item[enough], band[enough]
        width = self.edits[item] + 1
        return np.column_stack((item, band * width - shift, (band + 2) * width - shift))

    def align(self, codes: np.ndarray, item: int, low: int, high: int) -> tuple[int, int, int] | None:
        """Least edits of an occurrence whose diagonals, from the one it starts on, stay within the region; (edits, start, end)."""
        x, k = self.codes[item], int(self.edits[item])
        low, high = low - k, high + k
        n, wide = len(x), high - low
        far = n + k + 1
        # cost[d]: item characters read so far, text read up to low + d + rows; begin[d]: where that occurrence starts.
        d = np.arange(wide)
        place = low + d
        inside = (place >= 0) & (place <= len(codes))
        cost, begin = np.where(inside, 0, far), place.copy()
        padded = np.concatenate((np.full(max(0, -low) + 1, 0xFFFFFFFF, np.uint32), codes, np.full(max(0, high + n - len(codes)) + 1, 0xFFFFFFFF, np.uint32)))
        offset = max(0, -low) + 1
        for r in range(n):
            read = padded[offset + low + r : offset + low + r + wide]
            match = cost + (read != x[r])
            drop = np.append(cost[1:] + 1, far)  # an item character without one of the text
            source = np.append(begin[1:], 0)
            take = drop < match
            cost, begin = np.where(take, drop, match), np.where(take, source, begin)
            # A text character without one of the item: along the row, by a running minimum.
            run = np.minimum.accumulate(cost - d)
            from_left = run + d < cost
            if from_left.any():
                best = np.maximum.accumulate(np.where(cost - d == run, d, 0))
                cost, begin = np.where(from_left, run + d, cost), np.where(from_left, begin[best], begin)
            outside = (place + r + 1 < 0) | (place + r + 1 > len(codes))
            cost = np.where(outside, far, cost)
            if r % 8 == 7 and cost.min() > k:
                return None
        last = int(cost.argmin())
        return (int(cost[last]), int(begin[last]), int(place[last] + n)) if cost[last] <= k else None

    def occurrences(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int, int, int, int]]:
        """(text, item id, edits, start, end) of the best occurrence of each item in normalised texts, which are filtered together."""
        gap = np.full(int(self.edits.max(initial=0)) + 1, GAP, np.uint32)
        size = np.array([len(codes) for codes, _ in texts])
        starts = np.cumsum(size + len(gap)) - size - len(gap)
        joined = np.concatenate([x for codes, _ in texts for x in (codes, gap)])
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for begin in range(0, len(joined), PIECE):
            part = joined[begin : begin + PIECE + 2 * max(map(len, self.codes), default=0)]
            for item, low, high in self.regions(part).tolist():
                low, high = low + begin, high + begin
                first = max(0, int(np.searchsorted(starts, low, side="right")) - 1)
                while first < len(texts) and starts[first] < high + 2 * len(self.codes[item]):
                    at = int(starts[first])
                    found = self.align(texts[first][0], item, low - at, high - at) if low < at + size[first] else None
                    if found and ((first, item) not in best or found[0] < best[first, item][0]):
                        best[first, item] = found
                    first += 1
        long = [(t, self.ids[i], e, int(texts[t][1][a]), int(texts[t][1][b - 1]) + 1) for (t, i), (e, a, b) in sorted(best.items())]
        return long + [(t, i, 0, int(at[a]), int(at[b - 1]) + 1) for t, (codes, at) in enumerate(texts) if self.short for i, a, b in self.words(codes)]

    def words(self, codes: np.ndarray) -> list[tuple[int, int, int]]:
        """(item id, start, end) of the first place where each item without a q-gram stands as whole words."""
        bounded = np.concatenate(([32], codes, [32])).astype(np.uint32)
        starts, out = np.flatnonzero((bounded[:-1] == 32) & (bounded[1:] != 32)), []
        for n in sorted({len(x) // 4 for x in self.short}):
            at = starts[starts + n <= len(codes)]
            at = at[bounded[at + n + 1] == 32]
            left = {x for x in self.short if len(x) == 4 * n}
            first = np.array([np.frombuffer(x, np.uint32)[0] for x in left])
            for a in at[np.isin(codes[at], first)].tolist():
                if (x := codes[a : a + n].tobytes()) in left:
                    left.remove(x)
                    out += [(i, a, a + n) for i in self.short[x]]
        return out

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, edits, start, end) of the best occurrence of each item in a text; bounds are characters of the lower-cased text."""
        return [x[1:] for x in self.occurrences([normalised(text)])]


FOUND = pa.schema([("doc_id", pa.int64()), ("own", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def _scan(items, rate: float):
    """items: a broadcast block of at most BLOCK_BYTES of text."""

    def run(batches):
        block = Items(items.value, rate)
        for batch in batches:
            out: list[tuple] = []
            held: list = []
            texts: list = []
            size = 0
            for doc_id, own, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "own", "text")), strict=True):
                held.append((doc_id, own))
                texts.append(normalised(text or ""))
                size += len(texts[-1][0])
                if size >= PIECE:
                    out += [(*held[t], *x) for t, *x in block.occurrences(texts)]
                    held, texts, size = [], [], 0
            if texts:
                out += [(*held[t], *x) for t, *x in block.occurrences(texts)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], f.type) for k, f in enumerate(FOUND)], schema=FOUND)

    return run


def _occurrences(docs: DataFrame, benchmark: DataFrame, rate: float) -> DataFrame:
    """contaminated() with own, the hash of each row's text."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("own"), text.alias("text"))
    given = benchmark.where("text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string")).orderBy("item_id", "text")
    out, block, size = None, [], 0

    def scan():
        nonlocal out
        found = rows.mapInArrow(trimmed(_scan(docs.sparkSession.sparkContext.broadcast(list(block)), rate)), "doc_id long, own long, item_id long, edits long, start long, end long")
        out = found if out is None else out.union(found)

    for item_id, text in given.toLocalIterator():  # a block at a time on the driver
        if block and size + len(text) > BLOCK_BYTES:
            scan()
            block, size = [], 0
        block.append((item_id, text))
        size += len(text)
    scan()
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, item_id, edits, start, end: the best occurrence of each benchmark item (item_id, text) in each document (doc_id, text).

    An item occurs where its characters (letters and digits in lower case, one space for whatever lies between) align with a stretch
    of the document's with at most rate * length edits, or (length - q) / q if that is less. Items under q such characters occur
    where they stand as whole words, without edits; null and empty texts hold nothing. Repeated rows are found each; a null doc_id is reported as null.
    Items go to the executors in blocks of at most 4 MB of text, each block against all documents: a scan a block. Extra columns are not read.
    """
    return _occurrences(docs, benchmark, rate).drop("own")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """docs without the rows that hold a benchmark item, all columns as they are. Rows are told apart by doc_id and text: another row of the same doc_id, null too, stays."""
    found = _occurrences(docs, benchmark, rate).select(F.col("doc_id").alias("_held"), F.col("own").alias("_own")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(found["_held"]) & (F.xxhash64(docs["text"].cast("string")) == found["_own"])
    return docs.join(found, same, "left_anti")
