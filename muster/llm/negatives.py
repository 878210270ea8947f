"""Hard negatives by a distributed join over a Voronoi partition of norm-augmented vectors.

Scores are inner products. With M the largest norm, a row r gets one more component sqrt(M^2 - |r|^2) and an anchor q gets 0; then
|q - r|^2 = |q|^2 + M^2 - 2 * score, so the highest scores are the nearest rows, and the triangle inequality bounds them.

1. Rows are assigned to their nearest pivot; pivots are at most PIVOTS rows, chosen by hash. A cell's count, radii and labels are summed up in Spark.
2. Positives: a cell's anchors of one label are a group. From the radii nearest to the pivots follows a distance within which all the positives of
   any anchor of the group lie. A cell's rows of that label are replicated to the group only if they may lie within it.
3. Negatives: the positives of a group give the least and the greatest score that a negative of it may have. A cell's rows are replicated to
   the group only if some may score in between.
4. Groups of many anchors are cut into parts and what is replicated to a part into blocks, both by hash: a task joins at most about PART anchors
   with about BLOCK rows, exactly, and a window keeps the best of all blocks, most of it before its shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, groups, trimmed

#: Pivots at most; anchors a part; rows a block.
PIVOTS, PART, BLOCK = 16, 16384, 32768
#: Distances are computed in doubles; bounds give way by this share.
SLACK = 1e-6
#: Integers up to which sums of products are exact in doubles.
EXACT = 1 << 53
NO_ID = np.iinfo(np.int64).max

PREPARED = "id long, label long, v binary, norm2 double"


def pack(x: np.ndarray) -> bytes:
    """Integers in the fewest bytes each; the first byte says how many."""
    most = int(np.abs(x).max(initial=0))
    width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return bytes([width]) + x.astype(f"<i{width}").tobytes()


def unpack(blobs: list[bytes]) -> np.ndarray:
    """Vectors as rows of a matrix; shorter ones end in zeros."""
    if blobs and len({(len(b), b[0]) for b in blobs}) == 1:
        rows = np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), -1)[:, 1:]
        return np.ascontiguousarray(rows).view(f"<i{blobs[0][0]}").astype(np.int64)
    parts = [np.frombuffer(b, f"<i{b[0]}", offset=1) for b in blobs]
    out = np.zeros((len(parts), max((len(p) for p in parts), default=0)), np.int64)
    for row, p in zip(out, parts, strict=True):
        row[: len(p)] = p
    return out


def _prepare(scale: int):
    """Integer vectors of the rows that take part."""

    def run(batches):
        for batch in batches:
            column = batch.column("embedding")
            flat, offsets = column.flatten(), np.concatenate(([0], np.cumsum(np.array([len(x) if x.is_valid else 0 for x in column], np.int64))))
            x = np.floor(np.asarray(flat.to_numpy(zero_copy_only=False), np.float64) * scale)
            good = np.isfinite(x) & (np.abs(x) < 2.0**62)
            whole = np.concatenate(([0], np.cumsum(~good)))
            if np.any(np.isfinite(x) & ~good):
                raise ValueError("a component does not fit a long")
            keep = np.flatnonzero((whole[offsets[1:]] == whole[offsets[:-1]]) & column.is_valid().to_numpy(zero_copy_only=False) & batch.column("label").is_valid().to_numpy(zero_copy_only=False))
            ints = np.where(good, x, 0).astype(np.int64)
            rows = [ints[offsets[i] : offsets[i + 1]] for i in keep]
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("label").take(take), pa.array([pack(r) for r in rows], pa.binary()), pa.array([float(np.dot(r.astype(float), r)) for r in rows], pa.float64())], ["id", "label", "v", "norm2"])

    return run


def _assign(pivots, most: float):
    """Each row with its cell, its distance to the cell's pivot, and for anchors the same of the anchor's point."""

    def nearest(points: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p, p_last = pivots.value
        width = max(points.shape[1], p.shape[1])
        points, p = (np.pad(a.astype(np.float64), ((0, 0), (0, width - a.shape[1]))) for a in (points, p))
        d2 = (points**2).sum(1)[:, None] + (p**2).sum(1) - 2 * points @ p.T + (last[:, None] - p_last) ** 2
        cell = d2.argmin(1) if len(points) else np.zeros(0, np.int64)
        return cell, np.sqrt(np.maximum(d2[np.arange(len(points)), cell], 0))

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 8192):
                part = batch.slice(begin, 8192)
                norm2, v = part.column("norm2").to_numpy(), unpack(part.column("v").to_pylist())
                cell, r = nearest(v, np.sqrt(np.maximum(most - norm2, 0)))
                a_cell, a_r = nearest(v, np.zeros(len(v)))
                columns = [*part.columns, pa.array(cell, pa.int32()), pa.array(r), pa.array(a_cell, pa.int32()), pa.array(a_r)]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, "cell", "r", "a_cell", "a_r"])

    return run


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a @ b.T).astype(np.int64)


def _blocks(batches, exact: bool):
    """For each part and block: its anchors, its rows by id, and the vectors of both, as doubles where their products are exact."""
    for _, held in groups(batches, ["part", "block"]):
        anchor = held.column("anchor").to_numpy()
        anchors, rows = held.filter(pa.array(anchor)), held.filter(pa.array(~anchor))
        if anchors.num_rows and rows.num_rows:
            rows = rows.sort_by([("id", "ascending")])
            both = unpack(anchors.column("v").to_pylist() + rows.column("v").to_pylist()).astype(np.float64 if exact else np.int64)
            yield anchors, rows, rows.column("id").fill_null(NO_ID).to_numpy(), rows.column("label").to_numpy(), both[: anchors.num_rows], both[anchors.num_rows :]


def _local_positives(k: int, exact: bool):
    """The best k rows of its label of each anchor in a block, itself once left out."""

    def run(batches):
        for anchors, rows, ids, labels, a_v, v in _blocks(batches, exact):
            hashes, times, out = rows.column("vh").to_numpy(), np.minimum(rows.column("times").to_numpy(), k + 1), []
            a_ids, a_labels, a_hashes = anchors.column("id").to_numpy(), anchors.column("label").to_numpy(), anchors.column("vh").to_numpy()
            for label in np.unique(a_labels):
                mine = np.flatnonzero(labels == label)
                v_mine = v[mine]
                own = np.flatnonzero(a_labels == label)
                for begin in range(0, len(own) if len(mine) else 0, 256):
                    some = own[begin : begin + 256]
                    for i, s in zip(some, _scores(a_v[some], v_mine), strict=True):
                        if len(s) > k + 1:  # the anchor itself may be among them
                            at = np.flatnonzero(s >= np.partition(s, len(s) - k - 1)[len(s) - k - 1])
                        else:
                            at = np.arange(len(s))
                        at = at[np.argsort(-s[at], kind="stable")][: k + 1]
                        left = times[mine[at]] - ((ids[mine[at]] == a_ids[i]) & (hashes[mine[at]] == a_hashes[i]))
                        for j in np.repeat(at, left)[:k]:
                            out.append((int(a_ids[i]), int(label), int(a_hashes[i]), None if ids[mine[j]] == NO_ID else int(ids[mine[j]]), int(s[j])))
            yield _rows(out, ("id", "label", "vh", "other", "score"))

    return run


def _local_negatives(k: int, low: int, high: int, exact: bool):
    """For each positive of each anchor the best k rows in a block of other labels that score between low and high hundredths of the positive."""

    def run(batches):
        for anchors, rows, ids, labels, a_v, v in _blocks(batches, exact):
            times, out = np.minimum(rows.column("times").to_numpy(), k), []
            a_ids, a_labels, a_hashes, scores = (anchors.column(c).to_pylist() for c in ("id", "label", "vh", "scores"))
            for begin in range(0, len(a_ids), 256):
                for i, s in enumerate(_scores(a_v[begin : begin + 256], v), begin):
                    bands = {p: (-((-low * p) // 100), (high * p) // 100) for p in set(scores[i])}
                    least, most = min(b[0] for b in bands.values()), max(b[1] for b in bands.values())
                    at = np.flatnonzero((s >= least) & (s <= most) & (labels != a_labels[i]))
                    at = at[np.argsort(-s[at], kind="stable")]
                    down = -s[at]
                    for p, (lo, hi) in bands.items():
                        first, last = np.searchsorted(down, -hi), np.searchsorted(down, -lo, side="right")
                        if last > first:
                            some = at[first : min(last, first + k)]
                            for j in np.repeat(some, times[some])[:k]:
                                out.append((a_ids[i], a_labels[i], a_hashes[i], p, None if ids[j] == NO_ID else int(ids[j]), int(s[j])))
            yield _rows(out, ("id", "label", "vh", "positive_score", "other", "score"))

    return run


def _rows(out: list[tuple], names: tuple) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], list(names))


def _tasks(anchors: DataFrame, rows: DataFrame, needed: DataFrame, on: list[str], parts: DataFrame) -> DataFrame:
    """Anchors and rows dealt to (part, block).

    needed: group, *on (of the rows), rows of them; parts: group, parts, its anchors' number. A row goes to one block of each part of the groups it
    might serve, an anchor to all blocks of its part.
    """
    size = needed.groupBy("group").agg(F.greatest(F.lit(1), F.ceil(F.sum("rows") / BLOCK)).cast("int").alias("blocks"))
    plan = parts.join(size, "group")
    name = F.concat_ws(":", "group", "part")
    sent = rows.join(needed.drop("rows").join(plan, "group"), on).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
    sent = sent.select(name.alias("part"), F.expr("cast(pmod(xxhash64(id, vh, 7), blocks) as int)").alias("block"), F.lit(False).alias("anchor"), "id", "label", "vh", "v", "times", F.expr("cast(null as array<long>)").alias("scores"))
    held = anchors.join(plan, "group").withColumn("part", F.expr("cast(pmod(xxhash64(id, vh), parts) as int)")).withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
    held = held.select(name.alias("part"), "block", F.lit(True).alias("anchor"), "id", "label", "vh", "v", "times", "scores")
    return held.union(sent).repartition("part", "block").sortWithinPartitions("part", "block")


def hard_negatives(vectors: DataFrame, is_anchor: Callable[[Column], Column], positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of vectors (vec_id, embedding, label).

    Components become floor(scale * x). Anchors are the rows whose vec_id meets is_anchor. An anchor's positives are its best other rows of
    its label; for each, the best rows of other labels with low * positive <= 100 * negative <= high * positive follow, by score and then
    by vec_id, null last. Rows without label or vector, or with a null or non-finite component, take no part. Rows of a null vec_id take part, but are no
    anchors. Repeated rows are rows like others, each with results of its own. Vectors of other lengths count as ended by zeros. Scores that
    do not fit a long are an error. Extra columns are not read; an empty table gives no rows.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "negatives")
    given = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    prepared = given.mapInArrow(trimmed(_prepare(scale)), PREPARED).withColumn("vh", F.xxhash64("v"))
    prepared = scratch.write(prepared.groupBy("id", "label", "vh", "v", "norm2").agg(F.count("*").alias("times")), "prepared")
    most = prepared.agg(F.max("norm2")).first()[0] or 0.0
    if most >= 2.0**62:
        raise ValueError("scores do not fit a long")
    exact = most < EXACT
    chosen = prepared.select("v", "norm2").orderBy(F.xxhash64("id", "vh"), "id", "label").limit(PIVOTS).collect()
    p, p_last = unpack([bytes(r["v"]) for r in chosen]), np.sqrt(np.maximum(most - np.array([r["norm2"] for r in chosen]), 0))
    fields = "cell int, r double, a_cell int, a_r double"
    rows = prepared.mapInArrow(trimmed(_assign(spark.sparkContext.broadcast((p, p_last)), most)), f"id long, label long, vh long, v binary, norm2 double, times long, {fields}")
    rows = scratch.write(rows.withColumn("anchor", F.coalesce(is_anchor(F.col("id")), F.lit(False)) & F.col("id").isNotNull()), "rows")
    anchors = rows.where("anchor").withColumn("group", F.col("a_cell"))
    # Distances between pivots: at most PIVOTS squared rows.
    full = np.hstack([p, p_last[:, None]]) if len(p) else np.zeros((0, 1))
    between = [(i, j, float(np.sqrt(((full[i] - full[j]) ** 2).sum()))) for i in range(len(full)) for j in range(len(full))]
    between = spark.createDataFrame(between or [(0, 0, 0.0)], "group int, cell int, gap double")
    parts = scratch.write(anchors.groupBy("group").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")), "parts")
    slack = F.lit(SLACK) * F.lit(float(np.sqrt(most)) + 1.0)

    # Positives.
    k = positives + 1  # an anchor is a row of its label
    radii = rows.groupBy("cell", "label", "r").agg(F.sum("times").alias("n"))
    nearest = radii.withColumn("at", F.row_number().over(Window.partitionBy("cell", "label").orderBy("r"))).where(F.col("at") <= k)
    nearest = nearest.groupBy("cell", "label").agg(F.collect_list(F.struct("r", F.least("n", F.lit(k)).alias("n"))).alias("nearest"))
    cells = scratch.write(rows.groupBy("cell", "label").agg(F.count("*").alias("rows"), F.min("r").alias("r_low"), F.max("r").alias("r_high")).join(nearest, ["cell", "label"]), "cells")
    wide = anchors.groupBy("group", "label").agg(F.max("a_r").alias("u"))
    facing = scratch.write(wide.join(cells, "label").join(between, ["group", "cell"]), "facing")
    reach = facing.select("group", "label", F.explode("nearest").alias("x"), (F.col("u") + F.col("gap")).alias("d")).select("group", "label", (F.col("d") + F.col("x.r")).alias("d"), "x.n")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("group", "label").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reach = reach.withColumn("before", before).groupBy("group", "label").agg(F.max(F.when(F.col("before") < k, F.col("d"))).alias("reach"), F.sum("n").alias("n"))
    bound = F.when(F.col("n") >= k, F.col("reach")).otherwise(F.lit(float("inf")))
    nearer = F.greatest(F.col("gap") - F.col("u") - F.col("r_high"), F.col("r_low") - F.col("gap") - F.col("u"))
    needed = facing.join(reach.select("group", "label", bound.alias("bound")), ["group", "label"]).where(nearer <= F.col("bound") + slack).select("group", "cell", "label", "rows")
    needed = scratch.write(needed, "needed")
    bare = anchors.select("group", "id", "label", "vh", "v", "times", F.expr("cast(null as array<long>)").alias("scores"))
    found = _tasks(bare, rows.select("id", "label", "vh", "v", "times", "cell"), needed, ["cell", "label"], parts).mapInArrow(trimmed(_local_positives(positives, exact)), "id long, label long, vh long, other long, score long")
    best = Window.partitionBy("id", "label", "vh").orderBy(F.desc("score"), F.asc_nulls_last("other"))
    pairs = scratch.write(found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives), "positives")

    # Negatives.
    scored = anchors.join(pairs.groupBy("id", "label", "vh").agg(F.sort_array(F.collect_set("score")).alias("scores")), ["id", "label", "vh"])
    scored = scratch.write(scored.select("group", "id", "label", "vh", "v", "times", "norm2", "a_r", "scores"), "scored")
    band = scored.groupBy("group").agg(
        F.min(F.element_at("scores", 1)).alias("least"), F.max(F.element_at("scores", -1)).alias("most"), F.max("a_r").alias("u"), F.min("norm2").alias("n_low"), F.max("norm2").alias("n_high")
    )
    span = rows.groupBy("cell").agg(F.count("*").alias("rows"), F.min("r").alias("r_low"), F.max("r").alias("r_high"))
    near = F.greatest(F.lit(0.0), F.col("gap") - F.col("u") - F.col("r_high"), F.col("r_low") - F.col("gap") - F.col("u")) - slack
    far = F.col("gap") + F.col("u") + F.col("r_high") + slack
    upper = (F.col("n_high") + F.lit(most) - F.pow(F.greatest(near, F.lit(0.0)), F.lit(2.0))) / 2
    lower = (F.col("n_low") + F.lit(most) - F.pow(far, F.lit(2.0))) / 2
    wanted = (upper + 1 >= F.least(F.col("least") * low, F.col("least") * high) / 100) & (lower - 1 <= F.greatest(F.col("most") * high, F.col("most") * low) / 100)
    needed = scratch.write(band.join(between, "group").join(span, "cell").where(wanted).select("group", "cell", "rows"), "needed")
    found = _tasks(scored, rows.select("id", "label", "vh", "v", "times", "cell"), needed, ["cell"], parts).mapInArrow(trimmed(_local_negatives(negatives, low, high, exact)), "id long, label long, vh long, positive_score long, other long, score long")
    best = Window.partitionBy("id", "label", "vh", "positive_score").orderBy(F.desc("score"), F.asc_nulls_last("other"))
    hard = scratch.write(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives), "negatives")
    told = pairs.select("id", "label", "vh", F.col("other").alias("positive_id"), F.col("score").alias("positive_score")).join(hard, ["id", "label", "vh", "positive_score"])
    told = told.join(anchors.select("id", "label", "vh", "times"), ["id", "label", "vh"]).withColumn("nth", F.explode(F.expr("sequence(1L, times)")))
    return told.select(F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
