"""Removal of repeated byte strings, by suffix arrays that are built in two stages.

A window is a 100-byte string of a document. Its anchor is its 32-byte gram of least hash, which depends on the window's bytes alone, so
equal windows have equal anchors and neighbours mostly share one: windows fall into runs, and a run with its anchor's hash is all that must
meet its like. Documents are read three times, or four where anchors are hot:

1. Runs are dealt by anchor, without text; anchors met once are unique and go no further. Of an anchor that a slab of text repeats, one run
   is sent with their number, and the slab learns if the anchor has more than HOT runs in all.
2. The strings of the other runs are dealt by anchor. Each task builds the suffix array of its distinct strings: suffixes smaller than
   their successors are sorted directly, the rest are induced by scanning the buckets of first bytes, and adjacent suffixes that share
   100 bytes are the repeats. All but the first place of each are marked.
3. The strings at a hot anchor differ in what surrounds a common passage, so each of their windows goes by its own hash instead: first the
   hashes, one of a slab, and then, of those met twice, the strings, which are sorted as in 2.
4. Marked stretches come back to their documents and are cut out.

Work is dealt in cells of at most about CELL bytes of input; a task takes some cells one after another and holds one. Rows between tasks are packed:
one for each cell and slab of text. Equal strings of a slab are joined before they are dealt, so a passage of a third of all documents
reaches its cell once for each slab.
"""

from __future__ import annotations

import hashlib
from math import ceil

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bytes_of, mix, partitions, trimmed

WINDOW, GRAM = 100, 32
SPAN = WINDOW - GRAM + 1
SLAB, PART, CELL, TASK = 1 << 20, 1 << 20, 16 << 20, 512 << 20
#: Runs of an anchor beyond which its windows are dealt one by one.
HOT_RUNS = 1024
#: Bits of a gram's place in a slab, the same for all slabs: the hash bits left decide between grams.
PLACE_BITS = np.uint64(23)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: doc (its row's number or id), first window, windows but one, low bits of the anchor's hash, its cell, whether the anchor is hot
RUN = np.dtype([("doc", "<i8"), ("at", "<i4"), ("more", "u1"), ("low", "<u4"), ("part", "<i4"), ("hot", "u1")])
ANCHOR = np.dtype([("part", "<i4"), ("low", "<u4")])
WINDOW_AT = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("at", "<i4")])
MARK = np.dtype([("doc", "<i8"), ("begin", "<i4"), ("end", "<i4")])
PACKED = pa.schema([("cell", pa.int32()), ("kind", pa.int32()), ("doc", pa.int64()), ("blob", pa.binary()), ("extra", pa.binary())])
PACKED_DDL = "cell int, kind int, doc long, blob binary, extra binary"
TEXT, RUNS, SEEN, STRINGS, MARKS, HOT, KNOWN, WINDOWS = 9, 1, 2, 3, 4, 5, 6, 7
RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _packed(rows: list[tuple]):
    for i in range(0, len(rows), 500):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 500], strict=True), PACKED, strict=True)], schema=PACKED)


def _by(target: np.ndarray, *values: np.ndarray):
    """(target, values of its rows) for each target."""
    order = np.argsort(target, kind="stable")
    target = target[order]
    cut = np.flatnonzero(np.diff(target)) + 1
    begin, end = np.concatenate(([0], cut)).tolist(), np.concatenate((cut, [len(target)])).tolist()
    if len(target):
        for a, b in zip(begin, end, strict=True):
            yield int(target[a]), [v[order[a:b]] for v in values]


def cell_of(docs: np.ndarray, cells: int) -> np.ndarray:
    return (mix(np.asarray(docs).astype(np.int64).view(np.uint64)) % np.uint64(cells)).astype(np.int64)


def _to_docs(kind: int, rows: np.ndarray, cells: int) -> list[tuple]:
    """Packed rows that bring runs or marks to the cells of their documents."""
    return [(c, kind, None, x.tobytes(), None) for c, (x,) in _by(cell_of(rows["doc"], cells), rows)]


def _same(x: np.ndarray) -> np.ndarray:
    """(cell, low bits) of anchors as one number."""
    return x["part"].astype(np.uint64) << np.uint64(32) | x["low"].astype(np.uint64)


def stretches(doc: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int]]:
    """(doc, begin, end) of the stretches that the windows at these places cover, windows next to one another joined."""
    if not len(doc):
        return []
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order].astype(np.int64)
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1)))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:] - 1, [len(doc) - 1]))
    return list(zip(doc[first].tolist(), at[first].tolist(), (at[last] + WINDOW).tolist(), strict=True))


def anchors(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: (first window, last window, anchor's hash), of texts one after another."""
    n = len(data)
    if n < WINDOW:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    h, size, power = data.astype(np.uint64) + np.uint64(1), 1, BASE
    with np.errstate(over="ignore"):
        while size < GRAM:  # a power of two
            h = h[:-size] * power + h[size:]
            size, power = size * 2, power * power
    h = mix(h)
    low = (np.uint64(1) << PLACE_BITS) - np.uint64(1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # equal hashes: the first gram of the window
    reach = 1
    while reach * 2 <= SPAN:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < SPAN:
        least = np.minimum(least[: len(least) - (SPAN - reach)], least[SPAN - reach :])
    place = (least & low).astype(np.int64)
    inside = np.ones(len(place), bool)  # windows within one text
    for b in bounds[1:-1].tolist():
        inside[max(0, b - WINDOW + 1) : b] = False
    first = inside.copy()
    first[1:] &= (place[1:] != place[:-1]) | ~inside[:-1]
    begin = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= (place[1:] != place[:-1]) | ~inside[1:]
    return begin, np.flatnonzero(last), h[place[begin]]


def slabs(ids: list[int], texts: pa.Array):
    """Texts of about a slab together: (ids, bytes, bounds, place of the first byte in its text). Longer texts are cut, windows overlapping."""
    data, bounds = bytes_of(texts)
    k, rows = 0, len(ids)
    while k < rows:
        end = max(k + 1, int(np.searchsorted(bounds, bounds[k] + SLAB, side="right")) - 1)
        a, b = int(bounds[k]), int(bounds[end])
        if b - a <= 2 * SLAB:
            yield np.array(ids[k:end], np.int64), data[a:b], bounds[k : end + 1] - a, 0
        else:
            for at in range(0, b - a - WINDOW + 1, SLAB):
                part = data[a + at : min(b, a + at + SLAB + WINDOW - 1)]
                yield np.array(ids[k : k + 1], np.int64), part, np.array([0, len(part)]), at
        k = end


def _find(cells: int):
    """Runs of all texts, dealt by anchor: those alone in their slab, and one with their number for each anchor that the slab repeats, whose runs wait at the slab's cell."""

    def find(batches):
        for batch in batches:
            for ids, data, bounds, at in slabs(batch.column("doc").to_pylist(), batch.column("text")):
                begin, last, h = anchors(data, bounds)
                if not len(begin):
                    continue
                row = np.searchsorted(bounds, begin, side="right") - 1
                runs = np.zeros(len(begin), RUN)
                runs["doc"], runs["at"], runs["more"] = ids[row], begin - bounds[row] + at, last - begin
                runs["low"], runs["part"] = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) % np.uint64(cells)
                _, first, back, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                slab = np.array([int(ids[0]) ^ at << 20], np.int64)
                own = int(cell_of(slab, cells)[0])
                known = runs[times[back] > 1]
                out = [(own, KNOWN, None, known.tobytes(), None)] if len(known) else []
                sent, number = runs[first], times.astype(np.uint32)
                out += [(c, SEEN, own, r.tobytes(), n.tobytes()) for c, (r, n) in _by(sent["part"], sent, number)]
                yield from _packed(out)

    return find


def _cells(batches):
    """The packed rows of one cell after another, cells in order."""
    cell, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["cell"] != cell:
                if held:
                    yield cell, held
                cell, held = row["cell"], []
            held.append(row)
    if held:
        yield cell, held


def _repeated(cells: int, most: int):
    """Of the runs that meet at their anchor, those that are not alone go back to their documents, and hot anchors to the slabs that repeat them."""

    def repeated(batches):
        for _, rows in _cells(batches):
            out = [(r["cell"], r["kind"], None, r["blob"], None) for r in rows if r["kind"] == KNOWN]
            seen = [r for r in rows if r["kind"] == SEEN]
            if seen:
                parts = [np.frombuffer(r["blob"], RUN) for r in seen]
                runs, number = np.concatenate(parts), np.frombuffer(b"".join(r["extra"] for r in seen), np.uint32)
                slab = np.repeat([r["doc"] for r in seen], [len(x) for x in parts])
                _, back = np.unique(runs["low"], return_inverse=True)
                total = np.bincount(back, number)[back]
                runs["hot"] = total > most
                out += _to_docs(RUNS, runs[(number == 1) & (total > 1)], cells)
                tell = (number > 1) & (total > most)
                told = np.zeros(int(tell.sum()), ANCHOR)
                told["part"], told["low"] = runs["part"][tell], runs["low"][tell]
                out += [(c, HOT, None, x.tobytes(), None) for c, (x,) in _by(slab[tell], told)]
            yield from _packed(out)

    return repeated


def _told(cells: int):
    """The runs of anchors that their slab repeats, on their way to their documents; those of hot anchors are so marked. An anchor is hot wherever it is met."""

    def told(batches):
        for _, rows in _cells(batches):
            hot = np.unique(_same(np.frombuffer(b"".join(r["blob"] for r in rows if r["kind"] == HOT), ANCHOR)))
            out = []
            for r in rows:
                if r["kind"] == KNOWN:
                    runs = np.frombuffer(r["blob"], RUN).copy()
                    runs["hot"] = np.isin(_same(runs), hot)
                    out += _to_docs(RUNS, runs, cells)
            yield from _packed(out)

    return told


def _with_texts(batches):
    """For each cell its packed rows first, then its documents a batch at a time: (cell, rows, documents)."""
    cell, rows = None, []
    for batch in batches:
        cell_column, kinds = np.asarray(batch.column("cell")), np.asarray(batch.column("kind"))
        cuts = np.flatnonzero((np.diff(cell_column) != 0) | ((kinds[1:] == TEXT) != (kinds[:-1] == TEXT))) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if b == a:
                continue
            if cell_column[a] != cell:
                cell, rows = int(cell_column[a]), []
            part = batch.slice(a, b - a)
            if kinds[a] == TEXT:
                yield cell, rows, part
            else:
                rows += part.to_pylist()


def window_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the window at each place."""
    h, size, power, found = data.astype(np.uint64) + np.uint64(1), 1, BASE, {}
    with np.errstate(over="ignore"):
        while size <= 64:  # 100 = 64 + 32 + 4
            if size in (4, 32, 64):
                found[size] = h, power
            if size < 64:
                h = h[:-size] * power + h[size:]
            size, power = size * 2, power * power
        n = len(data) - WINDOW + 1
        out = found[64][0][:n] * found[32][1] + found[32][0][64 : 64 + n]
        return mix(out * found[4][1] + found[4][0][96 : 96 + n])


class Windows:
    """Windows of hot anchors' runs, a slab at a time: equal ones of a slab are marked but for the first, which is dealt by its hash."""

    def __init__(self, cells: int):
        self.cells, self.runs, self.texts, self.size = cells, [], [], 0

    def add(self, runs: np.ndarray, text: bytes):
        for r in runs:
            a, b = int(r["at"]), int(r["at"]) + int(r["more"]) + WINDOW
            self.runs.append(r)
            self.texts.append(text[a:b])
            self.size += b - a

    def leave(self) -> list[tuple]:
        if not self.runs:
            return []
        runs, data = np.array(self.runs, RUN), np.frombuffer(b"".join(self.texts), np.uint8)
        number = runs["more"].astype(np.int64) + 1
        start = np.cumsum(number + WINDOW - 1) - number - WINDOW + 1
        run = np.repeat(np.arange(len(runs)), number)
        step = np.arange(len(run)) - np.repeat(np.cumsum(number) - number, number)
        place, doc, at = start[run] + step, runs["doc"][run], runs["at"][run] + step
        h = window_hashes(data)[place]
        order = np.lexsort((at, doc, h))
        place, doc, at, h = place[order], doc[order], at[order], h[order]
        lead = np.concatenate(([True], h[1:] != h[:-1]))
        first = np.maximum.accumulate(np.where(lead, np.arange(len(h)), 0))
        again = np.flatnonzero(~lead)
        equal, offset = np.zeros(len(again), bool), np.arange(WINDOW)
        for k in range(0, len(again), 8192):
            x = again[k : k + 8192]
            equal[k : k + 8192] = (data[place[x, None] + offset] == data[place[first[x], None] + offset]).all(1)
        gone = again[equal]
        out = _to_docs(MARKS, np.array(stretches(doc[gone], at[gone]), MARK), self.cells)
        stay = np.ones(len(h), bool)
        stay[gone] = False
        sent = np.zeros(int(stay.sum()), WINDOW_AT)
        sent["hash"], sent["doc"], sent["at"] = h[stay], doc[stay], at[stay]
        out += [(c, WINDOWS, None, x.tobytes(), None) for c, (x,) in _by(((sent["hash"] >> np.uint64(32)) % np.uint64(self.cells)).astype(np.int64), sent)]
        self.runs, self.texts, self.size = [], [], 0
        return out


def _strings(cells: int):
    """The strings of documents' repeated runs, dealt by anchor. Equal strings of a slab go once, with their first place; the others are marked."""

    def strings(batches):
        last, runs, hot = None, None, Windows(cells)
        for cell, rows, part in _with_texts(batches):
            if cell != last:
                last, runs = cell, np.frombuffer(b"".join(r["blob"] for r in rows if r["kind"] == RUNS), RUN)
                runs = runs[np.lexsort((runs["at"], runs["doc"]))]
            docs = np.asarray(part.column("doc"))
            large, blobs = zstandard.ZstdDecompressor(), part.column("blob").to_pylist()
            first, end = np.searchsorted(runs["doc"], docs), np.searchsorted(runs["doc"], docs, side="right")
            held: dict[tuple[int, bytes], np.void] = {}
            marks, size, k = [], 0, 0
            while k < len(docs):
                own = runs[first[k] : end[k]]
                text = large.decompress(blobs[k]) if len(own) else b""
                warm = own["hot"] > 0
                for b in range(0, int(warm.sum()), SLAB // WINDOW):
                    hot.add(own[warm][b : b + SLAB // WINDOW], text)
                    if hot.size > SLAB:
                        yield from _packed(hot.leave())
                for r in own[~warm]:
                    a, w = int(r["at"]), int(r["more"])
                    key = (int(r["part"]), text[a : a + w + WINDOW])
                    known = held.get(key)
                    if known is None:
                        held[key] = r
                        size += w + WINDOW
                    elif (int(known["doc"]), int(known["at"])) <= (int(r["doc"]), a):
                        marks.append((int(r["doc"]), a, a + w + WINDOW))
                    else:
                        marks.append((int(known["doc"]), int(known["at"]), int(known["at"]) + w + WINDOW))
                        held[key] = r
                k += 1
                if size > 4 * SLAB or k == len(docs):
                    yield from _send(held, marks, cells)
                    held, marks, size = {}, [], 0
        yield from _packed(hot.leave())

    return strings


def _send(held, marks, cells: int):
    out = []
    if held:
        r = np.array(list(held.values()), RUN)
        texts = [key[1] for key in held]
        order = np.argsort(r["part"], kind="stable")
        part = r["part"][order]
        cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            out.append((int(part[a]), STRINGS, None, r[order[a:b]].tobytes(), zstandard.ZstdCompressor(1).compress(b"".join(texts[k] for k in order[a:b].tolist()))))
    if marks:
        out += _to_docs(MARKS, np.array(marks, MARK), cells)
    yield from _packed(out)


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number that sorts like them."""
    padded = np.concatenate((text, np.zeros(8, np.uint8))).astype(np.uint64)
    two = padded[:-1] << np.uint64(8) | padded[1:]
    four = two[:-2] << np.uint64(16) | two[2:]
    return (four[:-4] << np.uint64(32) | four[4:])[: len(text)]


def small_types(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their successors; the last is not."""
    n = len(text)
    differs = np.flatnonzero(text[1:] != text[:-1])
    nxt = np.searchsorted(differs, np.arange(n))
    small = np.zeros(n, bool)
    known = nxt < len(differs)
    at = differs[nxt[known]]
    small[known] = text[at] < text[at + 1]
    return small


def suffix_array(text: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """Places of all suffixes in the order of their first depth bytes at least, in two stages."""
    n = len(text)
    small, w = small_types(text), words_at(text)
    # Stage one: direct sorting, eight bytes at a time, of the suffixes smaller than their successors.
    order = np.flatnonzero(small)
    order = order[np.argsort(w[order], kind="stable")]
    same = np.zeros(len(order), np.int64)  # the first place of the group of equal prefixes
    if len(order):
        new = np.concatenate(([True], w[order][1:] != w[order][:-1]))
        same = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    for at in range(8, depth + 8, 8):
        if not len(order):
            break
        tied = np.zeros(len(order), bool)
        tied[1:] = same[1:] == same[:-1]
        tied[:-1] |= tied[1:]
        place = np.flatnonzero(tied)
        if not len(place):
            break
        suffix, group = order[place], same[place]
        key = np.where(suffix + at < n, w[np.minimum(suffix + at, n - 1)], np.uint64(0))
        o = np.lexsort((key, group))
        order[place], key = suffix[o], key[o]
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])))
        same[place] = place[np.maximum.accumulate(np.where(new, np.arange(len(place)), 0))]
    # Stage two: scan the buckets of first bytes in order; each suffix puts its predecessor, if larger, behind those of its bucket.
    cut = np.searchsorted(text[order], np.arange(257)) if len(order) else np.zeros(257, np.int64)
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[n - 1]].append(np.array([n - 1]))  # the last suffix follows the empty one
    done = []
    for c in range(256):
        front = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        bucket = []
        while len(front):  # within the bucket: runs of its byte
            bucket.append(front)
            before = front[front > 0] - 1
            front = before[text[before] == c]
        bucket.append(order[cut[c] : cut[c + 1]])
        scan = np.concatenate(bucket)
        done.append(scan)
        before = scan[scan > 0] - 1
        before = before[text[before] > c]
        for b, (x,) in _by(text[before], before):
            waiting[b].append(x)
    return np.concatenate(done)


def common_prefixes(text: np.ndarray, suffixes: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """Bytes that each suffix shares with the one before it, up to depth."""
    n, out = len(text), np.zeros(len(suffixes), np.int64)
    live = np.arange(1, len(suffixes))
    w = words_at(text)
    for at in range(0, depth, 8):
        if not len(live):
            break
        a, b = suffixes[live - 1] + at, suffixes[live] + at
        ok = (a < n) & (b < n)
        differ = np.where(ok, w[np.minimum(a, n - 1)] ^ w[np.minimum(b, n - 1)], ~np.uint64(0))
        share = np.full(len(live), 8, np.int64)
        for k in range(7, -1, -1):
            share[differ >> np.uint64(56 - 8 * k) > 0] = k
        share = np.minimum(share, np.maximum(0, n - np.maximum(a, b)))
        out[live] += share
        live = live[share == 8]
    return np.minimum(out, depth)


def _mark(cells: int):
    """Repeats among the strings that met at their anchors: all windows but the first of each are marked in their documents. Windows that met by their hash ask for their strings."""

    def mark(batches):
        for _, rows in _cells(batches):
            out = [(r["cell"], MARKS, None, r["blob"], None) for r in rows if r["kind"] == MARKS]
            strings = [r for r in rows if r["kind"] == STRINGS]
            large = zstandard.ZstdDecompressor()
            for r in strings:
                r["extra"] = large.decompress(r["extra"])
            marks = []
            # A cell of more strings than usual is worked off in parts that again hold all runs of an anchor.
            parts = sum(len(r["extra"]) for r in strings) // PART + 1
            distinct: list[dict[bytes, tuple[int, int]]] = [{} for _ in range(parts)]
            while strings:
                r = strings.pop()
                runs, text, at = np.frombuffer(r["blob"], RUN), r["extra"], 0
                for doc, begin, more, part in zip(runs["doc"].tolist(), runs["at"].tolist(), runs["more"].tolist(), (runs["low"] % parts).tolist(), strict=True):
                    string = text[at : at + more + WINDOW]
                    at += len(string)
                    known = distinct[part].get(string)
                    if known is None:
                        distinct[part][string] = (doc, begin)
                    else:  # a whole string again: the later place goes
                        late = max(known, (doc, begin))
                        distinct[part][string] = min(known, (doc, begin))
                        marks.append((late[0], late[1], late[1] + len(string)))
            while distinct:
                if len(found := distinct.pop()) > 1:
                    marks += _windows(found)
            if marks:
                out += _to_docs(MARKS, np.array(marks, MARK), cells)
            if met := [r["blob"] for r in rows if r["kind"] == WINDOWS]:
                windows = np.frombuffer(b"".join(met), WINDOW_AT)
                _, back, times = np.unique(windows["hash"], return_inverse=True, return_counts=True)
                windows = windows[times[back] > 1]
                runs = np.zeros(len(windows), RUN)
                runs["doc"], runs["at"] = windows["doc"], windows["at"]
                runs["low"], runs["part"] = windows["hash"] & np.uint64(0xFFFFFFFF), (windows["hash"] >> np.uint64(32)) % np.uint64(cells)
                out += _to_docs(RUNS, runs, cells)
            yield from _packed(out)

    return mark


def _windows(distinct: dict[bytes, tuple[int, int]]) -> list[tuple[int, int, int]]:
    size = np.array([len(s) for s in distinct])
    text = np.frombuffer(b"".join(distinct), np.uint8)
    start = np.cumsum(size) - size
    row = np.repeat(np.arange(len(size)), size)
    offset = np.arange(len(text)) - start[row]
    whole = offset <= size[row] - WINDOW  # suffixes that begin a window
    suffixes = suffix_array(text)
    suffixes = suffixes[whole[suffixes]]
    shared = common_prefixes(text, suffixes) >= WINDOW
    group = np.cumsum(~shared)
    places = np.array(list(distinct.values()), np.int64)
    doc, at = places[row[suffixes], 0], places[row[suffixes], 1] + offset[suffixes]
    order = np.lexsort((at, doc, group))
    later = np.zeros(len(order), bool)
    later[1:] = group[order][1:] == group[order][:-1]
    return stretches(doc[order][later], at[order][later])


def _cut(with_text: bool):
    def cut(batches):
        last, marks = None, None
        for cell, rows, part in _with_texts(batches):
            if cell != last:
                last, marks = cell, np.frombuffer(b"".join(r["blob"] for r in rows if r["kind"] == MARKS), MARK)
                marks = marks[np.lexsort((marks["begin"], marks["doc"]))]
            docs = np.asarray(part.column("doc"))
            large, blobs = zstandard.ZstdDecompressor(), part.column("blob").to_pylist()
            first, end = np.searchsorted(marks["doc"], docs), np.searchsorted(marks["doc"], docs, side="right")
            out = []
            for k, (doc, blob) in enumerate(zip(docs.tolist(), blobs, strict=True)):
                own, kept, done, spans, removed = marks[first[k] : end[k]], [], 0, 0, 0
                text = large.decompress(blob)
                begin, stop = -1, -1
                for x, y in zip(own["begin"].tolist(), own["end"].tolist(), strict=True):
                    if x > stop:
                        if stop >= 0:
                            kept.append(text[done:begin])
                            done, spans, removed = stop, spans + 1, removed + stop - begin
                        begin, stop = x, y
                    else:
                        stop = max(stop, y)
                if stop >= 0:
                    kept.append(text[done:begin])
                    done, spans, removed = stop, spans + 1, removed + stop - begin
                kept.append(text[done:])
                left = b"".join(kept)
                out.append((doc, len(text), removed, spans, hashlib.sha256(left).hexdigest(), left if with_text else None))
            for i in range(0, len(out), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[i : i + 2000], strict=True), RESULT, strict=True)], schema=RESULT)

    return cut


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept if with_text.

    Texts are UTF-8 bytes, null is empty. Each byte is removed that a 100-byte string covers which also starts earlier: in a smaller doc_id or
    earlier in the same document; strings are those of the input and do not cross documents. Removed stretches that touch count as one.
    Rows that share a doc_id, or have none, are ordered by their text's hash (null ids first); rows equal in both are one document, which every
    one of them returns. Texts under 100 bytes lose nothing. `kept` may end within a character, so it is binary. Extra columns are not read; an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = rows.groupBy("doc_id").agg(F.count("*").alias("times"), F.sum(F.octet_length("text")).alias("size"))
    whole = ids.agg(F.sum("size").alias("size"), F.count(F.when(F.expr("times > 1 or doc_id is null"), 1)).alias("odd")).first()
    tasks = max(partitions(spark), ceil((whole["size"] or 0) / TASK))
    each = max(1, ceil((whole["size"] or 0) / tasks / CELL))
    cells = tasks * each
    if not whole["odd"]:
        named, names = rows.withColumnRenamed("doc_id", "doc"), None
    else:  # numbers in order of (doc_id, text's hash), one for rows equal in both
        key = [F.col("doc_id").asc_nulls_first(), F.col("sha").asc()]
        distinct = rows.groupBy("doc_id", F.sha2("text", 256).alias("sha")).agg(F.count("*").alias("copies"))
        names = scratch.write(distinct.repartitionByRange(tasks, *key).sortWithinPartitions(*key).withColumn("doc", F.monotonically_increasing_id()), "names")
        own = rows.withColumn("own", F.sha2("text", 256))
        met = own.join(names, own["doc_id"].eqNullSafe(names["doc_id"]) & (F.col("own") == F.col("sha"))).select("doc", "text", "copies")
        named = met.where("copies = 1").select("doc", "text").union(met.where("copies > 1").groupBy("doc").agg(F.first("text").alias("text")))
    texts = named.mapInArrow(trimmed(_dealt(cells)), PACKED_DDL)

    def dealt(df):
        return df.repartitionById(tasks, F.expr(f"cast(cell div {each} as int)")).sortWithinPartitions("cell", "kind", "doc")

    # Between the steps small tables are written, so that each step's shuffle files can go before the next.
    found = scratch.write(dealt(named.mapInArrow(trimmed(_find(cells)), PACKED_DDL)).mapInArrow(trimmed(_repeated(cells, HOT_RUNS)), PACKED_DDL), "runs")
    told = dealt(found.where(F.col("kind").isin(HOT, KNOWN))).mapInArrow(trimmed(_told(cells)), PACKED_DDL)
    runs = found.where(F.col("kind") == RUNS).union(told)
    marks = scratch.write(dealt(dealt(runs.union(texts)).mapInArrow(trimmed(_strings(cells)), PACKED_DDL)).mapInArrow(trimmed(_mark(cells)), PACKED_DDL), "marks")
    scratch.drop(found)
    warm, marks = marks.where(F.col("kind") == RUNS), marks.where(F.col("kind") == MARKS)
    if not warm.isEmpty():
        marks = marks.union(scratch.write(dealt(dealt(warm.union(texts)).mapInArrow(trimmed(_strings(cells)), PACKED_DDL)).mapInArrow(trimmed(_mark(cells)), PACKED_DDL), "marks"))
    out = dealt(marks.union(texts)).mapInArrow(trimmed(_cut(with_text)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    if names is not None:
        each_row = names.select("doc", "doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
        out = out.withColumnRenamed("doc_id", "doc").join(each_row, "doc").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    return out if with_text else out.drop("kept")


def _dealt(cells: int):
    """Texts as packed rows, dealt by document."""

    def dealt(batches):
        for batch in batches:
            docs = batch.column("doc")
            cell = cell_of(np.asarray(docs), cells).astype(np.int32)
            none, small = pa.nulls(len(docs), pa.binary()), zstandard.ZstdCompressor(1)
            data, bounds = bytes_of(batch.column("text"))
            blobs = [small.compress(data[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.full(len(docs), TEXT, np.int32)), docs, pa.array(blobs, pa.binary()), none], schema=PACKED)

    return dealt
