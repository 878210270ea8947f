"""Join of texts by the Jaccard similarity of their word n-grams, with Bayesian pruning of candidates.

1. Rows with equal n-gram sets form a class; one row of each class goes on, with its MinHash values.
2. Values are banded. Two classes are candidates when a band of theirs is equal, and the bucket of the first such band alone compares them:
   each candidate pair is compared once, and no other pair is. A bucket of more than BLOCK members is cut into blocks by hash, and each pair of
   its blocks is a group of its own, so that no bucket is held whole.
3. MinHash values are compared a batch at a time; a pair is dropped once the posterior probability of reaching the threshold falls below the
   tolerance. The first pass has the values alone and tells which members have pairs left. Their n-gram sets are then sent where they are
   needed, and what pruning leaves is verified exactly. Pairs are counted in place and never leave as rows.
4. Links give each row its number of links and, by connected components, its class id.

With 24 bands of 4 values a pair of similarity 0.8 is a candidate with probability 1 - (1 - 0.8^4)^24 = 0.999997, and more surely above.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, groups, mix, partitions, trimmed
from .words import shingle_sets

HASHES, ROWS, STEP = 96, 4, 16
#: Members of a block of a bucket, and their n-grams: buckets of long texts are cut finer.
BLOCK, BLOCK_GRAMS = 256, 1 << 19
TOLERANCE = 1e-6


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(1, n + 1, dtype=np.uint64)
    return mix(at) | np.uint64(1), mix(at + np.uint64(1 << 32))


def minhash(grams: np.ndarray) -> np.ndarray:
    a, b = _seeds(HASHES)
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(grams), 1024):
        np.minimum(out, (grams[i : i + 1024, None] * a + b).min(0), out=out)
    return (out >> np.uint64(48)).astype(np.uint16)  # a band of four is a number of 64 bits


@lru_cache
def least_matches(threshold: float, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """By n compared values, the fewest matches m with P(similarity >= threshold | m of n) >= tolerance, from a uniform prior."""
    out = [0]
    for n in range(1, HASHES + 1):
        total = 0.0
        for m in range(n + 1):
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)  # P(Bin(n + 1, t) <= m)
            if total >= tolerance:
                break
        out.append(m)
    return tuple(out)


def signatures(size: int):
    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for doc_id, own, grams in zip(batch.column("doc_id").to_pylist(), batch.column("own").to_pylist(), shingle_sets(batch.column("text"), size), strict=True):
                out.append((doc_id, own, _key(grams), len(grams), minhash(grams).astype("<u2").tobytes()) if len(grams) else (doc_id, own, None, 0, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), SIGNED, strict=True)], schema=SIGNED)

    return run


SIGNED = pa.schema([("doc_id", pa.int64()), ("own", pa.int64()), ("key", pa.binary()), ("n", pa.int32()), ("sig", pa.binary())])
LINKS = pa.schema([("kind", pa.string()), ("a", pa.binary()), ("b", pa.binary()), ("links", pa.int64())])
GROUP = ["band", "bucket", "low", "high"]


def _key(grams: np.ndarray) -> bytes:
    """128 bits that name a set of n-grams."""
    with np.errstate(over="ignore"):
        return np.array([mix(grams).sum(), mix(grams ^ np.uint64(0x5851F42D4C957F2D)).sum() ^ np.uint64(len(grams))], np.uint64).tobytes()


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def verified(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs reach the threshold, exactly."""
    used, place = np.unique(np.concatenate((i, j)), return_inverse=True)
    i, j = place[: len(i)], place[len(i) :]
    own = [sets[k] for k in used.tolist()]
    size = np.array([len(x) for x in own])
    if len(i) <= 64:
        both = np.array([len(np.intersect1d(own[x], own[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist(), strict=True)])
    else:
        flat = np.concatenate(own)
        row = np.repeat(np.arange(len(own)), size)
        order = np.argsort(flat, kind="stable")
        flat, row = flat[order], row[order]
        number = np.concatenate(([0], np.cumsum(flat[1:] != flat[:-1])))
        held = np.bincount(number)
        shared = held[number] > 1  # a gram of one set alone adds to no intersection
        column = np.cumsum(held > 1)[number[shared]] - 1
        row = row[shared]
        total = np.zeros((len(own), len(own)), np.float32)
        width = 4096
        edge = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + width + 1, width))
        for k in range(len(edge) - 1):
            part = np.zeros((len(own), width), np.float32)
            part[row[edge[k] : edge[k + 1]], column[edge[k] : edge[k + 1]] - k * width] = 1
            total += part @ part.T
        both = total[i, j].astype(np.int64)
    whole = size[i] + size[j] - both
    return both >= threshold * whole - 1e-9


def surviving(sig: np.ndarray, band: int, left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of left and right rows (all pairs with left < right if they are the same) of which this band is the first equal one and that pruning leaves."""
    least, within, bands = least_matches(threshold), left is right, sig.view("<u8")
    found_i, found_j = [], []
    for k, i in enumerate(left.tolist()):
        others = right[k + 1 :] if within else right
        if band:
            others = others[~(bands[others, :band] == bands[i, :band]).any(1)]
        match = np.zeros(len(others), np.int64)
        for step in range(0, HASHES, STEP):
            if not len(others):
                break
            match += (sig[others, step : step + STEP] == sig[i, step : step + STEP]).sum(1)
            keep = match >= least[step + STEP]
            others, match = others[keep], match[keep]
        found_i.append(np.full(len(others), i))
        found_j.append(others)
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(found_i or empty), np.concatenate(found_j or empty)


def _compared(threshold: float, key: tuple, rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of one pair of blocks that pruning leaves."""
    sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), "<u2").reshape(rows.num_rows, HASHES)
    block, (band, _, low, high) = np.asarray(rows.column("block")), key
    left = np.flatnonzero(block == low)
    return surviving(sig, band, left, left if low == high else np.flatnonzero(block == high), threshold)


def _needed(threshold: float):
    """Of the members of each pair of blocks, those with a pair left."""

    def run(batches):
        for key, rows in groups(batches, GROUP):
            if rows.num_rows > 1:
                pairs = _compared(threshold, key, rows)
                used = np.unique(np.concatenate(pairs))
                if len(used):
                    yield from rows.select([*GROUP, "block", "key"]).take(used).combine_chunks().to_batches()

    return run


def _pairs(threshold: float):
    def run(batches):
        for key, rows in groups(batches, GROUP):
            i, j = _compared(threshold, key, rows)
            if not len(i):
                continue
            keys, weight = rows.column("key").to_pylist(), np.array(rows.column("n_docs"))
            real = verified([np.frombuffer(x, np.uint64) for x in rows.column("grams").to_pylist()], i, j, threshold)
            i, j = i[real], j[real]
            links = np.bincount(i, weight[j], len(keys)) + np.bincount(j, weight[i], len(keys))
            forest = Forest(len(keys))
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                forest.join(x, y)
            out = [("edge", keys[x], keys[forest.root(x)], 0) for x in range(len(keys)) if forest.root(x) != x]
            out += [("links", keys[x], None, int(links[x])) for x in np.flatnonzero(links).tolist()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), LINKS, strict=True)], schema=LINKS)

    return run


def _grams(size: int):
    def run(batches):
        for batch in batches:
            keep, blobs = [], []
            for i, (key, grams) in enumerate(zip(batch.column("key").to_pylist(), shingle_sets(batch.column("text"), size), strict=True)):
                if len(grams) and _key(grams) == key:  # else another text of one hash
                    keep.append(i)
                    blobs.append(grams.tobytes())
            part = batch.drop_columns(["text"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(blobs, pa.binary())], names=[*part.schema.names, "grams"])

    return run


def _dealt(members: DataFrame) -> DataFrame:
    return members.repartition(*GROUP).sortWithinPartitions(*GROUP, "key")


def candidates(scratch: Scratch, classes: DataFrame, threshold: float) -> DataFrame:
    """band, bucket, low, high, block, key: the members of each pair of blocks that have a pair left after pruning."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(HASHES // ROWS - 1)), lambda b: F.substring(F.col("sig"), b * 2 * ROWS + 1, F.lit(2 * ROWS)))
    rows = classes.select("key", "n", F.posexplode(bands).alias("band", "bucket"))
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.col("n").cast("long")) / BLOCK_GRAMS)).cast("int")
    # Tables are written before they are joined, so that both sides of a join come from a shuffle and skewed ones can be split.
    shared = scratch.write(rows.groupBy("band", "bucket").agg(blocks.alias("blocks"), F.count("*").alias("members")).where("members > 1").drop("members"), "shared")
    members = rows.drop("n").join(shared, ["band", "bucket"]).withColumn("block", F.expr("cast(pmod(xxhash64(key), blocks) as int)"))
    members = scratch.write(members, "members").join(classes.select("key", "sig"), "key")
    members = members.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    members = members.select("band", "bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "key", "sig")
    return scratch.write(_dealt(members).mapInArrow(trimmed(_needed(threshold)), "band int, bucket binary, low int, high int, block int, key binary"), "needed")


def _joined(docs: DataFrame, threshold: float, size: int) -> DataFrame:
    """doc_id, own, class, class_id, class_size, n_links of each row: own is its text's hash, class what its class is known by, null for rows without n-grams."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("own"), text.alias("text"))
    signed = scratch.write(rows.mapInArrow(trimmed(signatures(size)), "doc_id long, own long, key binary, n int, sig binary"), "signed")
    # One row of a class is read again by its id and its text's hash.
    grouped = signed.where("key is not null").groupBy("key").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("least_id"), F.min(F.struct("own", "doc_id")).alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = scratch.write(grouped.select("key", "n_docs", "least_id", F.col("rep.own").alias("own"), F.col("rep.doc_id").alias("rep"), "n", "sig"), "classes")
    needed = candidates(scratch, classes, threshold)
    used = scratch.write(needed.select("key").distinct().join(classes, "key").select("key", "n_docs", "sig", F.col("own").alias("rep_own"), "rep"), "used")
    with_text = used.join(rows, (F.col("rep_own") == rows["own"]) & F.col("rep").eqNullSafe(rows["doc_id"])).select("key", "n_docs", "sig", "text")
    sets = with_text.mapInArrow(trimmed(_grams(size)), "key binary, n_docs long, sig binary, grams binary").dropDuplicates(["key"])
    found = scratch.write(_dealt(needed.join(sets, "key")).mapInArrow(trimmed(_pairs(threshold)), "kind string, a binary, b binary, links long"), "links")
    links = found.where("kind = 'links'").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    labels = components(scratch, found.where("kind = 'edge'").select("a", "b")).withColumnRenamed("node", "key")
    per = scratch.write(classes.select("key", "n_docs", "least_id").join(labels, "key", "left").join(links, "key", "left"), "labelled")
    whole = scratch.write(per.where("label is not null").groupBy("label").agg(F.min("least_id").alias("class_id"), F.sum("n_docs").alias("class_size")), "whole")
    n_links = (F.coalesce("links", F.lit(0)) + F.col("n_docs") - 1).alias("n_links")
    linked = per.join(whole, "label").select("key", F.col("label").alias("class"), "class_id", "class_size", n_links)
    single = per.where("label is null").select("key", F.col("key").alias("class"), F.col("least_id").alias("class_id"), F.col("n_docs").alias("class_size"), n_links)
    each = scratch.write(linked.union(single), "classed")
    told = signed.where("key is not null").select("doc_id", "own", "key").join(each, "key").drop("key")
    alone = signed.where("key is null").select("doc_id", "own", F.lit(None).cast("binary").alias("class"), F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links"))
    return told.union(alone)


def jaccard_join(docs: DataFrame, threshold: float = 0.8, size: int = 5) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, class_id, class_size, n_links.

    Two rows are linked when the Jaccard similarity of their sets of word n-grams reaches the threshold. n_links counts the
    other rows linked with a row, copies among them; class_id is the least doc_id among the rows reached over links, class_size
    their number. Null and empty texts, and texts without a word, have no n-grams and no links: each is its own class. Texts of
    fewer words than n have one n-gram, all their words. Rows that repeat a doc_id are rows like others; null doc_ids take part,
    and a class of them alone has a null class_id. Extra columns are not read; an empty table gives no rows.
    """
    return _joined(docs, threshold, size).select("doc_id", "class_id", "class_size", "n_links")


def drop_near_copies(docs: DataFrame, threshold: float = 0.8, size: int = 5) -> DataFrame:
    """docs with one row of each class, all columns as they are.

    It is the row with the least doc_id, null last, and of rows that share it that with the least hash of its text; of rows equal in both one stays, that with the least hash of
    its columns. Rows are told apart by doc_id and text, so another row of the same doc_id goes only if its own class says so. Rows without a word all stay.
    """
    scratch = Scratch(docs.sparkSession, "kept")
    found = scratch.write(_joined(docs, threshold, size).where("class is not null").groupBy("class", "doc_id", "own").agg(F.count("*").alias("times")), "rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "own")).alias("first")
    first = scratch.write(found.groupBy("class").agg(first, F.sum("times").alias("members")).where("members > 1").drop("members"), "first")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("own") == F.col("first.own"))
    judged = scratch.write(found.join(first, "class").select("doc_id", "own", "times", stays.alias("stays")), "judged")
    return keep_rows(docs, judged)


def keep_rows(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """docs without the rows that judged (doc_id, own, times, stays) lets go, and with one of the rows that stay where they are several."""
    text = F.col("text").cast("string")

    def same(some: DataFrame):
        return docs["doc_id"].cast("long").eqNullSafe(some["_id"]) & (F.xxhash64(docs["text"].cast("string")) == some["_own"])

    gone = judged.where("not stays or times > 1").select(F.col("doc_id").alias("_id"), F.col("own").alias("_own"))
    several = judged.where("stays and times > 1").select(F.col("doc_id").alias("_id"), F.col("own").alias("_own"))
    rest = docs.join(gone, same(gone), "left_anti")
    if several.isEmpty():
        return rest
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.dataType.typeName() != "map"]
    rows = docs.join(several, same(several), "left_semi").select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("own"), F.xxhash64(*plain).alias("tie"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rest.union(rows.groupBy("id", "own").agg(F.min_by("row", "tie").alias("row")).select("row.*"))
