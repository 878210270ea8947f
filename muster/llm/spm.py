"""SentencePiece encoding by an Aho-Corasick automaton and a single-pass Viterbi, and decoding.

The automaton reads bytes; the pieces that end at a place are met by following output links, longest first. The vocabulary was made by merges, so
the path that counts is not a best sum of its scores, which are ranks of merges, but the one that the merges make. That is a best path over pairs:
a piece may follow another only if the two, merged from their characters in order of rank, come out as these two again. Each place then has one piece
that can end there, given those before it, and the path is the one that the vocabulary's own library gives. Whether a pair holds is seen by undoing both
pieces' merges along their common border, the later one first: it does not hold if a merge across the border would have come before.

A character that is no piece is unknown and falls back to byte pieces. No piece holds a space after another character, so a text's path is that of its runs,
each of spaces and what follows them: each distinct run is solved once, and many runs at a time, place by place. A run of spaces alone merges last, from the left.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, slices, trimmed
from .simple8b import _ranges

MARK = "▁"
NONE, UNKNOWN, START = -2, -1, -3  # what ends at a place, where no piece does
NEVER = np.int32(np.iinfo(np.int32).max)
#: Distinct runs kept, and their bytes; cells of a step; runs solved one by one; bytes from which a run is cut.
KEPT, KEPT_BYTES, CELLS, FEW, LONG = 400_000, 32 << 20, 1 << 19, 6, 1 << 12


class Merges:
    """Pieces (text, rank) as merges of characters: which pairs may stand side by side."""

    def __init__(self, pieces: list[tuple[str, int]]):
        self.slots = {text: k for k, (text, _) in enumerate(pieces)}
        n = len(pieces)
        #: When a piece is merged; characters are there from the start.
        self.when = np.array([-1 if len(text) == 1 else rank for text, rank in pieces], np.int32)
        self.left, self.right, self.real = np.arange(n), np.arange(n), np.array([len(text) == 1 for text, _ in pieces])
        splits = [(self.slots[text[:i]], self.slots[text[i:]], k) for k, (text, _) in enumerate(pieces) for i in range(1, len(text)) if text[:i] in self.slots and text[i:] in self.slots]
        a, b, whole = (np.array(x, np.int64) for x in zip(*splits, strict=True)) if splits else (np.zeros(0, np.int64),) * 3
        keys = a * n + b
        order = np.argsort(keys)
        self.keys, self.ranks, self.n = keys[order], self.when[whole[order]], n
        size = np.array([len(text) for text, _ in pieces])
        for length in range(2, int(size.max(initial=0)) + 1):  # a piece is what its own characters merge to, else it is never met
            some = np.flatnonzero((size[whole] == length) & self.real[a] & self.real[b])
            some = some[self.fits(a[some], b[some], False)]
            self.left[whole[some]], self.right[whole[some]], self.real[whole[some]] = a[some], b[some], True

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """When the pair merges."""
        key = a * self.n + b
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        return np.where(self.keys[at] == key, self.ranks[at], NEVER) if len(self.keys) else np.full(len(key), NEVER)

    def fits(self, a: np.ndarray, b: np.ndarray, whole: bool = True) -> np.ndarray:
        """Whether the characters of a and b merge to a and b; with not whole, up to the merge of the two."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        ok, live = np.ones(len(a), bool), np.arange(len(a))
        end_a, end_b = np.full(len(a), NEVER), np.full(len(a), NEVER)  # when each is merged into the next
        while len(live):
            x, y = a[live], b[live]
            if whole:
                r = self.rank(x, y)
                across = (r < end_a[live]) & (r <= end_b[live]) & (r < NEVER)  # of equal merges the left one is first
                ok[live[across]] = False
                live, x, y = live[~across], x[~across], y[~across]
            whole = True
            left_later = self.when[x] > self.when[y]
            end_a[live[left_later]], a[live[left_later]] = self.when[x[left_later]], self.right[x[left_later]]
            other = ~left_later & (self.when[y] >= 0)
            end_b[live[other]], b[live[other]] = self.when[y[other]], self.left[y[other]]
            live = live[left_later | other]
        return ok


class Automaton:
    """Pieces as bytes, a space for the mark. goto is complete: one step a byte. A node that nothing follows has no row of its own: it goes on as the one it fails to."""

    def __init__(self, pieces: list[tuple[bytes, int]]):
        ends: list[tuple[int, int, int]] = []
        children: list[dict[int, int]] = [{}]
        for text, number in pieces:
            node = 0
            for b in text:
                nxt = children[node].get(b)
                if nxt is None:
                    nxt = children[node][b] = len(children)
                    children.append({})
                node = nxt
            ends.append((node, number, len(text)))
        n = len(children)
        inner = np.array([k == 0 or bool(c) for k, c in enumerate(children)])
        self.row, self.goto = np.cumsum(inner, dtype=np.int32) - 1, np.zeros((int(inner.sum()), 256), np.int32)
        fail, self.link, self.depth = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.piece, self.size = np.full(n, -1, np.int32), np.zeros(n, np.int32)
        for node, number, size in ends:
            self.piece[node], self.size[node] = number, size
        level, depth = [0], 0
        while level:
            deeper = []
            for node in level:
                f = fail[node]
                self.depth[node] = depth
                if inner[node]:
                    row = self.goto[self.row[f]].copy() if node else self.goto[0]
                    for b, child in children[node].items():
                        fail[child] = row[b] if node else 0
                        row[b] = child
                        deeper.append(child)
                    self.goto[self.row[node]] = row
                else:
                    self.row[node] = self.row[f]
                self.link[node] = f if self.piece[f] >= 0 else self.link[f]
            level, depth = deeper, depth + 1


class Coder:
    """Encodes and decodes with the pieces and ranks of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.table: list[bytes] = []
        pieces, numbers, self.spaces, self.byte = [], [], {}, np.zeros(256, np.int32)
        for k in range(model.get_piece_size()):
            text = model.id_to_piece(k)
            if model.is_byte(k):
                self.byte[int(text[3:5], 16)] = k
                self.table.append(bytes([int(text[3:5], 16)]))
            elif model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
                self.table.append(b"")
            else:
                if MARK in text.lstrip(MARK) or (len(text) - len(text.lstrip(MARK)) > 1 and text.strip(MARK)):
                    raise ValueError("a piece with an inner space: runs of a text depend on one another")
                self.table.append(text.replace(MARK, " ").encode())
                if not text.strip(MARK):
                    self.spaces[len(text)] = k
                if len(text) == 1 or text.strip(MARK):
                    pieces.append((text.replace(MARK, " "), int(-model.get_score(k))))
                    numbers.append(k)
        self.merges, self.number = Merges(pieces), np.array(numbers, np.int32)
        self.auto = Automaton([(text.encode(), k) for k, (text, _) in enumerate(pieces) if self.merges.real[k]])
        self.flat = np.frombuffer(b"".join(self.table), np.uint8)
        self.ends = np.concatenate(([0], np.cumsum([len(x) for x in self.table])))
        self.blank = {0: []}
        self.clear()

    def clear(self):
        self.place: dict[str, int] = {}
        self.held, self.bounds, self.known, self.size, self.pairs = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64), 0, 0, {}

    def of_spaces(self, n: int) -> list[int]:
        """Ids of a run of spaces: all its merges are of one rank, so the leftmost pair that is a piece goes first."""
        if n > 512:  # the same piece again and again, but for the end
            first = self.of_spaces(256)[0]
            width = len(self.table[first])
            return [first] * ((n - 256) // width) + self.of_spaces(n - (n - 256) // width * width)
        if n not in self.blank:
            widths, at = [1] * n, 0
            while at + 1 < len(widths):
                if widths[at] + widths[at + 1] in self.spaces:
                    widths[at : at + 2] = [widths[at] + widths[at + 1]]
                    at = max(0, at - 1)
                else:
                    at += 1
            self.blank[n] = [self.spaces[w] for w in widths]
        return self.blank[n]

    def one(self, text: bytes) -> list[int]:
        """The path of one run, place by place, in a few bytes for each of its own."""
        a, n = self.auto, len(text)
        last, back, state, begin = array("i", [NONE]) * (n + 1), array("i", [0]) * (n + 1), 0, 0
        last[0] = START
        for t in range(n):
            state = int(a.goto[a.row[state], text[t]])
            if text[t] & 0xC0 != 0x80:
                begin = t
            if t + 1 < n and text[t + 1] & 0xC0 == 0x80:
                continue  # within a character
            node = state if a.piece[state] >= 0 else int(a.link[state])
            while node:
                x, width = int(a.piece[node]), int(a.size[node])
                before = last[t + 1 - width]
                if before != NONE and (before < 0 or self.fits(before, x)):
                    last[t + 1], back[t + 1] = x, width
                    break
                node = int(a.link[node])
            else:
                last[t + 1], back[t + 1] = UNKNOWN, t + 1 - begin
        out, t = [], n
        while t:
            x, width = last[t], back[t]
            out += [int(self.number[x])] if x >= 0 else [int(self.byte[b]) for b in reversed(text[t - width : t])]
            t -= width
        return out[::-1]

    def fits(self, a: int, b: int) -> bool:
        found = self.pairs.get((a, b))
        if found is None:
            found = self.pairs[a, b] = bool(self.merges.fits(np.array([a]), np.array([b]))[0])
        return found

    def many(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for runs of about one length, all in step: ids, counts and the order of runs."""
        a, n = self.auto, len(texts)
        order = np.argsort([-len(x) for x in texts], kind="stable")
        size = np.array([len(texts[k]) for k in order.tolist()])
        longest = int(size[0])
        text = np.zeros((longest + 1, n), np.uint8)
        flat = np.frombuffer(b"".join(texts[k] for k in order.tolist()), np.uint8)
        start = np.concatenate(([0], np.cumsum(size)))
        for t in range(longest):
            live = int(np.searchsorted(-size, -t, side="left"))
            text[t, :live] = flat[start[:live] + t]
        last, length = np.full((longest + 1, n), NONE, np.int32), np.zeros((longest + 1, n), np.int32)
        last[0] = START
        state, begin = np.zeros(n, np.int32), np.zeros(n, np.int64)
        for t in range(longest):
            live = int(np.searchsorted(-size, -t, side="left"))
            now = text[t, :live]
            state[:live] = a.goto[a.row[state[:live]], now]
            begin[:live][(now & 0xC0) != 0x80] = t
            at = np.flatnonzero(((text[t + 1, :live] & 0xC0) != 0x80) | (size[:live] == t + 1))  # a character ends
            node = state[at]
            node = np.where(a.piece[node] >= 0, node, a.link[node])
            took, span, rows = np.full(len(at), NONE, np.int32), np.zeros(len(at), np.int32), np.flatnonzero(node)
            while len(rows):
                x = a.piece[node[rows]]
                width = a.size[node[rows]]
                before = last[t + 1 - width, at[rows]]
                good = (before == START) | (before == UNKNOWN)
                asked = np.flatnonzero(before >= 0)
                good[asked] = self.merges.fits(before[asked], x[asked])
                took[rows[good]], span[rows[good]] = x[good], width[good]
                rows = rows[~good]
                node[rows] = a.link[node[rows]]
                rows = rows[node[rows] > 0]
            alone = took == NONE
            took[alone], span[alone] = UNKNOWN, (t + 1 - begin[at])[alone]
            last[t + 1, at], length[t + 1, at] = took, span
        # Back along all paths in step; a path's pieces are met last first.
        found, at, row = [], size.copy(), np.arange(n)
        while len(row):
            k, w = last[at, row], length[at, row]
            found.append((row, at, k, w))
            at = at - w
            row, at = row[at > 0], at[at > 0]
        row, at, k, w = (np.concatenate(x) for x in zip(*found, strict=True))
        o = np.lexsort((at, row))
        row, at, k, w = row[o], at[o], k[o], w[o]
        each = np.where(k >= 0, 1, w)  # an unknown character gives its bytes
        ids = np.repeat(np.where(k >= 0, self.number[np.maximum(k, 0)], 0), each)
        unknown = np.flatnonzero(k < 0)
        if len(unknown):
            first = np.cumsum(each) - each
            ids[_ranges(first[unknown], w[unknown])] = self.byte[flat[_ranges(start[row[unknown]] + at[unknown] - w[unknown], w[unknown])]]
        return ids, np.bincount(row, each, n).astype(np.int64), order

    def parts(self, text: bytes) -> list[bytes]:
        """A long run cut where no piece can lie across: there its path is that of both sides."""
        goto, own, depth, state, cuts = self.auto.goto, self.auto.row, self.auto.depth, 0, [0]
        for t, b in enumerate(text):
            state = goto[own[state], b]
            if depth[state] <= 1 and b & 0xC0 != 0x80 and t - cuts[-1] >= 64:
                cuts.append(t)
        return [text[x:y] for x, y in zip(cuts, [*cuts[1:], len(text)], strict=True)]

    def solve(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all runs one after another, and their counts."""
        raw = [x.encode() for x in texts]
        odd = [k for k, x in enumerate(raw) if x[:2] == b"  " or x == b" " or len(x) > LONG or not x]
        if not odd:
            ids, bounds = self._solved(raw)
            return ids, np.diff(bounds)
        cores, plans = list(raw), []
        for k in odd:  # spaces before the word, and the word in parts
            word = raw[k].lstrip(b" ")
            blanks = len(raw[k]) - len(word)
            core = b" " * (blanks > 0) + word if word else b""
            own = self.parts(core) if len(core) > LONG else [core] if core else []
            cores[k] = b""
            plans.append((k, blanks, range(len(cores), len(cores) + len(own))))
            cores += own
        ids, bounds = self._solved(cores)
        begin, counts, pool, end = bounds[: len(raw)].copy(), np.diff(bounds)[: len(raw)], [ids], len(ids)
        for k, blanks, own in plans:
            found = ids[bounds[own.start] : bounds[own.stop]]
            if blanks > 1 or not own:
                alone = not own or int(found[0]) == self.spaces[1]  # else the last space is the word's
                found = np.concatenate((np.array(self.of_spaces(blanks if alone else blanks - 1), np.int32), found[1:] if alone and own else found))
            pool.append(found)
            begin[k], counts[k] = end, len(found)
            end += len(found)
        return np.concatenate(pool)[_ranges(begin, counts)], counts

    def _solved(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found: list[np.ndarray] = [np.zeros(0, np.int32)]
        counts = np.zeros(len(texts), np.int64)
        which = [np.zeros(0, np.int64)]
        lengths = np.array([len(x) for x in texts], np.int64)
        order = np.argsort(lengths, kind="stable")
        lengths = lengths[order].tolist()
        begin = lengths.count(0)  # empty ones have no ids
        while begin < len(order):
            end = begin + 1
            while end < len(order) and (end - begin + 1) * (lengths[end] + 1) <= CELLS and lengths[end] <= 2 * lengths[begin] + 16:
                end += 1
            part = order[begin:end]
            if len(part) > FEW:
                ids, count, own = self.many([texts[k] for k in part.tolist()])
                part = part[own]
            else:
                lists = [self.one(texts[k]) for k in part.tolist()]
                ids, count = np.array([x for ids in lists for x in ids], np.int32), np.array([len(x) for x in lists])
            found.append(ids)
            counts[part] = count
            which.append(part)
            begin = end
        ids, which = np.concatenate(found), np.concatenate(which)
        at = np.zeros(len(texts), np.int64)
        at[which] = np.cumsum(counts[which]) - counts[which]
        return ids[_ranges(at, counts)], np.concatenate(([0], np.cumsum(counts)))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and each text's bounds among them. A text begins as if after a space; an empty one has no ids."""
        if len(self.place) > KEPT or self.size > KEPT_BYTES:
            self.clear()
        column = column.fill_null("")
        odd = pc.or_(pc.or_(pc.match_substring(column, "  "), pc.match_substring(column, MARK)), pc.or_(pc.starts_with(column, " "), pc.ends_with(column, " ")))
        if pc.any(odd).as_py():  # runs of many spaces
            lists = [re.findall(" +[^ ]*", " " + x.replace(MARK, " ")) if x else [] for x in column.to_pylist()]
            owner, flat = np.concatenate(([0], np.cumsum([len(x) for x in lists]))), pa.array([y for x in lists for y in x], pa.string())
            lead = False
        else:
            runs = pc.split_pattern(column, " ")
            owner, flat, lead = np.asarray(runs.offsets) - runs.offsets[0].as_py(), runs.flatten(), True
        coded = flat.dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if lead:
            words = [" " + w for w in words]
        places = np.array([self.place.get(w, -1) for w in words], np.int64)
        unseen = np.flatnonzero(places < 0)
        if len(unseen):
            new = [words[k] for k in unseen.tolist()]
            extra, counts = self.solve(new)
            end, known = int(self.bounds[self.known]), self.known
            while end + len(extra) > len(self.held):
                self.held = np.concatenate((self.held, np.zeros_like(self.held)))
            while known + len(new) >= len(self.bounds):
                self.bounds = np.concatenate((self.bounds, np.zeros_like(self.bounds)))
            self.held[end : end + len(extra)] = extra
            self.place |= zip(new, range(known, known + len(new)), strict=True)
            self.bounds[known + 1 : known + 1 + len(new)] = end + np.cumsum(counts)
            self.known += len(new)
            self.size += sum(map(len, new))
            places[unseen] = [self.place[w] for w in new]
        bounds = self.bounds
        use = places[np.asarray(coded.indices)] if words else np.zeros(0, np.int64)
        size = bounds[use + 1] - bounds[use]
        if lead:  # an empty text is split into one empty run
            size[owner[:-1][np.asarray(pc.equal(column, ""))]] = 0
        return self.held[_ranges(bounds[use], size)], np.concatenate(([0], np.cumsum(size)))[owner]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts, each still after its first space, and each text's bounds among them."""
        size = np.diff(self.ends)[ids]
        return self.flat[_ranges(self.ends[ids], size)], np.concatenate(([0], np.cumsum(size)))[bounds]


@lru_cache(maxsize=1)
def coder(path: str) -> Coder:
    return Coder(path)


def _encoded(path: str, with_ids: bool):
    def run(batches):
        c = coder(path)
        for batch in batches:
            for part in slices(batch, 1 << 21):
                text = part.column("text")
                ids, bounds = c.encode(text)
                data, own = bytes_of(text)
                back, at = c.decode(ids, bounds)
                raw = ids.astype("<u4").tobytes()
                whole, given = back.tobytes(), data.tobytes()
                own, at, b = own.tolist(), at.tolist(), bounds.tolist()
                same = [whole[at[k] + 1 : at[k + 1]] == given[own[k] : own[k + 1]] for k in range(len(own) - 1)]
                columns = {"doc_id": part.column("doc_id"), "n_pieces": pa.array(np.diff(bounds)), "ids_crc32": pa.array([zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(b[:-1], b[1:], strict=True)], pa.int64()), "round_trip": pa.array(same)}
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_pydict(columns)

    return run


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, round_trip and ids of each row of docs (doc_id, text).

    Null and empty texts have no ids. round_trip is whether the ids decode to the text: they do unless it holds the mark's own
    character, which is a space to the model. Rows that repeat are coded alike, null doc_ids stay, extra columns are not read, an empty
    table gives no rows.
    """
    return _rows(docs).mapInArrow(trimmed(_encoded(model, True)), "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean, ids array<int>")


def digest(docs: DataFrame, model: str) -> DataFrame:
    """encoded() without the ids."""
    return _rows(docs).mapInArrow(trimmed(_encoded(model, False)), "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean")


def _decoded(path: str):
    def run(batches):
        c = coder(path)
        for batch in batches:
            lists = batch.column("ids")
            bounds = np.asarray(lists.offsets)
            back, at = c.decode(np.asarray(lists.flatten()), bounds - bounds[0])
            whole = back.tobytes()
            texts = [whole[x + 1 : y].decode("utf-8", "replace") for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decoded(coded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows of doc_id and ids; no ids are an empty text."""
    return coded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(trimmed(_decoded(model)), "doc_id long, text string")
