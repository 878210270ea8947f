"""Token ids in Simple-8b: 64-bit words of a 4-bit selector and 60 bits of equally wide ids.

A selector tells how many ids a word packs and how wide they are. Ids of 2^60 and more escape: selector 15 packs one place in the
block's list of escaped ids. A shard is a row sequence of blocks; a block holds whole documents, where each begins among its words and among its escapes, and the
number of ids of the shard before it. So all words of a block decode at once, and any document by itself.
Blocks are rows of Parquet files, whose writer commits whole files: lost executors leave no half shard, and any store that Spark
reads holds them.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bytes_of, partitions, trimmed

# Fixed values of the coding, by selector: ids in a word, bits of an id.
COUNT = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTH = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
# Selectors 0 and 1 are runs of 240 and 120 ones in the usual coding; here, of zeros. One id of 60 bits shares selector 15 with escapes:
# the id 2^60 - 1 announces an escape, whose value is the next of the block's list.
ESCAPE = np.uint64((1 << 60) - 1)
BLOCK_BYTES = 1 << 21
BLOCK = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("escape_offsets", pa.list_(pa.int64())), ("words", pa.binary()), ("escapes", pa.binary())])


#: The narrowest width that holds an id, by id below 2^15.
_BITS = WIDTH[1:][np.searchsorted(1 << WIDTH[1:13], np.arange((1 << 15) + 1), side="right")].astype(np.uint8)


def encode(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, each document's bounds among the words, and escaped ids, of documents' ids one after another.

    Each document starts a word. The widest packing that fits is taken at each place, in all documents in step.
    """
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    out_of = ids >= ESCAPE
    escapes, ids = ids[out_of], np.where(out_of, ESCAPE, ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64), escapes
    bits = _BITS[np.minimum(ids, np.uint64(1 << 15)).astype(np.int64)]
    large = np.flatnonzero(ids >= np.uint64(1 << 15))
    for less, width in zip(WIDTH[12:15].tolist(), WIDTH[13:].tolist(), strict=True):
        bits[large[ids[large] >= np.uint64(1 << less)]] = width
    end = np.repeat(bounds[1:], np.diff(bounds))
    room = (end - np.arange(n)).astype(np.int32)
    choice = np.full(n, 15, np.uint8)
    most = bits.copy()  # the widest id of the next `reach`
    reach = 1
    for s in range(15, -1, -1):  # windows grow
        count, width = int(COUNT[s]), int(WIDTH[s])
        while reach * 2 <= count:
            most = np.concatenate((np.maximum(most[:-reach], most[reach:]), most[-reach:])) if reach < n else most
            reach *= 2
        if int(most.min()) > width:
            continue
        shift = count - reach
        widest = np.concatenate((np.maximum(most[: n - shift], most[shift:]), most[n - shift :])) if 0 < shift < n else most
        fits = np.flatnonzero(widest <= width)
        choice[fits[room[fits] >= count]] = s
    taken_at, taken_doc, live = [], [], np.flatnonzero(np.diff(bounds))
    at = bounds[:-1][live].copy()
    step = COUNT[choice]
    while len(live) > 24:
        taken_at.append(at)
        taken_doc.append(live)
        at = at + step[at]
        more = at < bounds[1:][live]
        at, live = at[more], live[more]
    for k, place in zip(live.tolist(), at.tolist(), strict=True):  # the few longest, one by one
        stop, own = int(bounds[k + 1]) - place, step[place : int(bounds[k + 1])].tolist()
        hops, x = [], 0
        while x < stop:
            hops.append(x)
            x += own[x]
        taken_at.append(place + np.array(hops))
        taken_doc.append(np.full(len(hops), k))
    first = np.concatenate(taken_at)
    order = np.argsort(first, kind="stable")
    first, doc = first[order], np.concatenate(taken_doc)[order]
    sel = choice[first].astype(np.uint64)
    words = sel << np.uint64(60)
    for s in range(2, 16):
        rows = np.flatnonzero(sel == s)
        if len(rows):
            packed = np.zeros(len(rows), np.uint64)
            for k in range(int(COUNT[s])):
                packed |= ids[first[rows] + k] << np.uint64(k * WIDTH[s])
            words[rows] |= packed
    return words, np.searchsorted(doc, np.arange(len(bounds))).astype(np.int64), escapes


def decode(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """All ids of a block, whichever documents they are of."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    count = COUNT[sel]
    start = np.concatenate(([0], np.cumsum(count)))
    ids = np.zeros(start[-1], np.uint64)
    for s in np.unique(sel[sel > 1]).tolist():
        rows = np.flatnonzero(sel == s)
        mask = np.uint64((1 << int(WIDTH[s])) - 1)
        for k in range(int(COUNT[s])):
            ids[start[rows] + k] = (words[rows] >> np.uint64(k * WIDTH[s])) & mask
    if len(escapes):
        ids[np.flatnonzero(ids == ESCAPE)] = escapes
    return ids


#: The byte-level alphabet: printable bytes stand for themselves, the others for letters from 256 on, in order.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
ALPHABET = {b: chr(b) for b in _PRINTED} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in set(_PRINTED))}
#: Words that the vocabulary's rules leave whole: lower-cased, they are one letter run and in composed form.
PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Such a word and one run of signs, which the rules part; an apostrophe could begin a suffix, and < a special token.
ENDED = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=>?@[-`{-~]+)")
PARTED = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<signs>[!-&(-/:;=>?@\[-`{-~]*)$"
#: Bytes, read as Latin-1, to that alphabet; line ends stay.
BYTES = {k: v for k, v in ALPHABET.items() if k != 10}


def escape_offsets(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Each document's bounds among the escaped ids."""
    return np.concatenate(([0], np.cumsum(np.asarray(ids, np.uint64) >= ESCAPE)))[bounds]


def decode_document(words: np.ndarray, escapes: np.ndarray, offsets, escape_offsets, k: int) -> np.ndarray:
    """The ids of a block's k-th document, from its own words and escapes alone."""
    return decode(words[offsets[k] : offsets[k + 1]], escapes[escape_offsets[k] : escape_offsets[k + 1]])


class Tokenizer:
    """Ids of whole texts by the tokenizers library, each distinct word encoded once.

    The vocabulary's rules drop white space and match nothing across it, and a letter run ends before a full stop or comma,
    so a text's ids are its words' ids in order. Plain words go to the library's model, all else through its whole pipeline.
    """

    #: Distinct words kept, and their bytes.
    KEPT, KEPT_BYTES = 500_000, 32 << 20

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)
        rules = json.loads(self.library.to_str())
        steps = [str(x.get("type")) for x in (rules["normalizer"] or {}).get("normalizers", [])], [str(x.get("type")) for x in (rules["pre_tokenizer"] or {}).get("pretokenizers", [])]
        if steps != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]):
            raise ValueError("the vocabulary's rules must lower-case and must drop white space")
        self.model = self.library.model
        self.clear()

    def clear(self):
        self.place: dict[str, int] = {}
        self.signs: dict[str, list[int]] = {}
        self.held, self.bounds = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)
        self.known, self.size = 0, 0

    def ids(self, word: str) -> list[int]:
        if PLAIN.fullmatch(word):
            word = word.lower()
            return [t.id for t in self.model.tokenize(word if word.isascii() else "".join(map(ALPHABET.__getitem__, word.encode())))]
        if parts := ENDED.fullmatch(word):
            if parts[2] not in self.signs:
                self.signs[parts[2]] = self.library.encode(parts[2], add_special_tokens=False).ids
            return self.ids(parts[1]) + self.signs[parts[2]]
        return self.library.encode(word, add_special_tokens=False).ids

    def learn(self, words: list[str]):
        """Puts new words' ids behind those held. Plain words, with or without signs behind them, are made ready together and go to the model straight."""
        given = pa.array(words, pa.string())
        parts = pc.extract_regex(given, PARTED)
        plain, signs = pc.utf8_lower(pc.fill_null(parts.field("word"), "")), parts.field("signs").to_pylist()
        ready = "\n".join(plain.to_pylist()).encode().decode("latin-1").translate(BYTES).split("\n") if words else []
        model, found = self.model.tokenize, []
        for word, low, tail in zip(words, ready, signs, strict=True):
            if not low:
                found.append(self.ids(word))
            elif tail:
                if tail not in self.signs:
                    self.signs[tail] = self.library.encode(tail, add_special_tokens=False).ids
                found.append([t.id for t in model(low)] + self.signs[tail])
            else:
                found.append([t.id for t in model(low)])
        self.size += int(pc.sum(pc.binary_length(given)).as_py() or 0)
        flat = np.fromiter(chain.from_iterable(found), np.uint32)
        end, known = int(self.bounds[self.known]), self.known
        while end + len(flat) > len(self.held):
            self.held = np.concatenate((self.held, np.zeros_like(self.held)))
        while known + len(words) >= len(self.bounds):
            self.bounds = np.concatenate((self.bounds, np.zeros_like(self.bounds)))
        self.held[end : end + len(flat)] = flat
        self.place |= zip(words, range(known, known + len(words)), strict=True)
        self.bounds[known + 1 : known + 1 + len(words)] = end + np.cumsum([len(x) for x in found])
        self.known += len(words)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and each text's bounds among them."""
        if len(self.place) > self.KEPT or self.size > self.KEPT_BYTES:
            self.clear()
        runs = pc.ascii_split_whitespace(column.fill_null(""))
        owner = np.asarray(runs.offsets) - runs.offsets[0].as_py()
        coded = runs.flatten().dictionary_encode()
        # A full stop or comma after an ASCII letter is a word of its own, if it ends its run.
        data, bounds = bytes_of(coded.dictionary)
        size = np.diff(bounds)
        end = np.maximum(bounds[1:], 2)
        padded = np.concatenate((data, np.zeros(2, np.uint8)))
        ended = (size > 1) & ENDS[padded[end - 1]] & LETTER[padded[end - 2]]
        body = pc.if_else(pa.array(ended), pc.utf8_slice_codeunits(coded.dictionary, 0, -1), coded.dictionary).dictionary_encode()
        words = [*body.dictionary.to_numpy(zero_copy_only=False).tolist(), ".", ","]
        place = np.array([self.place.get(w, -1) for w in words], np.int64)
        if len(new := np.flatnonzero(place < 0)):
            self.learn(list(dict.fromkeys(words[k] for k in new.tolist())))
            place[new] = [self.place[words[k]] for k in new.tolist()]
        first = place[:-2][np.asarray(body.indices)] if len(words) > 2 else np.zeros(0, np.int64)
        second = np.where(ended, np.where(padded[end - 1] == 46, place[-2], place[-1]), -1)
        # Ids of each distinct run, one after another, then of all runs.
        bounds = self.bounds
        n1, n2 = bounds[first + 1] - bounds[first], np.where(second >= 0, bounds[second + 1] - bounds[second], 0)
        spread = np.column_stack((first, second)).ravel()
        part = _ranges(bounds[spread], np.column_stack((n1, n2)).ravel())
        ids, own = self.held[part], np.concatenate(([0], np.cumsum(n1 + n2)))
        use = np.asarray(coded.indices)
        count = (n1 + n2)[use]
        return ids[_ranges(own[use], count)], np.concatenate(([0], np.cumsum(count)))[owner]


ENDS, LETTER = np.zeros(256, bool), np.zeros(256, bool)
ENDS[[44, 46]] = True
LETTER[65:91] = LETTER[97:123] = True


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... size[0] of them, then those of begin[1]."""
    end = np.cumsum(size)
    return np.repeat(begin - (end - size), size) + np.arange(end[-1] if len(end) else 0)


@lru_cache(maxsize=1)
def tokenizer_of(path: str) -> Tokenizer:
    """One for each worker, whose tasks share what it has learned."""
    return Tokenizer(path)


TABLE = "shard int, block int, before long, doc_ids array<long>, counts array<long>, offsets array<long>, escape_offsets array<long>, words binary, escapes binary"


def _write(path: str, last: int):
    def run(batches):
        tokenizer, shard, block, before = tokenizer_of(path), TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            text = batch.column("text")
            size = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))))
            begin = 0
            while begin < len(text):  # a few MB of text, or one document, a block
                end = max(begin + 1, int(np.searchsorted(size, size[begin] + BLOCK_BYTES, side="right")) - 1)
                ids, bounds = tokenizer.encode(text.slice(begin, end - begin))
                counts = np.diff(bounds) + 1
                whole = np.insert(ids, bounds[1:], last)
                ends = np.concatenate(([0], np.cumsum(counts)))
                words, offsets, escapes = encode(whole, ends)
                row = (shard, block, before, batch.column("doc_id").slice(begin, end - begin).to_pylist(), counts.tolist(), offsets.tolist(), escape_offsets(whole, ends).tolist(), words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, BLOCK, strict=True)], schema=BLOCK)
                begin, block, before = end, block + 1, before + int(counts.sum())

    return run


def write_tokens(docs: DataFrame, tokenizer: str, last: int, path: str) -> None:
    """Writes the ids of docs (doc_id, text), each document ended by the id last, in ascending doc_id order.

    Null texts count as empty and are the end id alone; null doc_ids come first; rows that repeat a doc_id follow one another by
    their text's hash, so that one id of a third of all rows is split as well. Extra columns are not read. An empty table writes
    a folder without blocks.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = partitions(docs.sparkSession)
    tie = F.xxhash64("text")
    dealt = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    dealt.mapInArrow(trimmed(_write(tokenizer, last)), TABLE).write.parquet(path)


def _read(batches):
    for batch in batches:
        for row in batch.to_pylist():
            ids = decode(np.frombuffer(row["words"], "<u8"), np.frombuffer(row["escapes"], "<u8"))
            raw, counts = ids.astype("<u4").tobytes(), np.array(row["counts"], np.int64)
            end = np.cumsum(counts)
            crc = [zlib.crc32(raw[4 * (b - c) : 4 * b]) for b, c in zip(end.tolist(), counts.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(row["first"] + row["before"] + end - counts), pa.array(counts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def blocks(spark, path: str) -> DataFrame:
    """The blocks of a written table with `first`, the ids of all shards before their own.

    Shards are as many as write tasks, so their sums are a small table, over which one ordered sum runs.
    """
    written = spark.read.schema(TABLE).parquet(path)
    sums = written.select("shard", F.expr("aggregate(counts, 0L, (a, x) -> a + x)").alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = sums.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return written.join(F.broadcast(first), "shard")


def digest(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document of a written table, read from its blocks."""
    return blocks(spark, path).select("before", "doc_ids", "counts", "words", "escapes", "first").mapInArrow(trimmed(_read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _some(batches):
    for batch in batches:
        for row in batch.to_pylist():
            words, escapes, ids, out = np.frombuffer(row["words"], "<u8"), np.frombuffer(row["escapes"], "<u8"), row["doc_ids"], []
            for k in row["places"]:
                out.append((ids[k], decode_document(words, escapes, row["offsets"], row["escape_offsets"], k).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int64()), pa.array([x for _, x in out], pa.list_(pa.int64()))], names=["doc_id", "ids"])


def read_documents(spark, path: str, wanted: DataFrame) -> DataFrame:
    """doc_id, ids of the documents of a written table whose doc_id is in wanted (doc_id): blocks without any are not decoded, and of the others only the documents asked for.

    Rows that repeat a doc_id give a row each; null ids are not found.
    """
    written = spark.read.schema(TABLE).parquet(path)
    places = written.select("shard", "block", F.posexplode("doc_ids").alias("k", "doc_id")).join(wanted.select(F.col("doc_id").cast("long")).distinct(), "doc_id", "left_semi")
    some = places.groupBy("shard", "block").agg(F.sort_array(F.collect_list("k")).alias("places"))
    held = written.join(some, ["shard", "block"]).select("doc_ids", "offsets", "escape_offsets", "words", "escapes", "places")
    return held.mapInArrow(trimmed(_some), "doc_id long, ids array<long>")


def round_trip(docs: DataFrame, tokenizer: str, last: int = 2) -> DataFrame:
    """digest() of docs written by write_tokens(): a row for each row of docs, odd ones as stated there, none for an empty table."""
    path = Scratch(docs.sparkSession, "tokens").path("shards")
    write_tokens(docs, tokenizer, last, path)
    return digest(docs.sparkSession, path)
