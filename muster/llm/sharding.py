"""Sharding by extendible hashing.

The directory is indexed by bits of a row's hash. All rows start in one bucket; only a bucket over the byte limit splits, on the next bit, until
every bucket fits. Eight bits are tried in one pass: cells of the deepest prefix are summed first, before any shuffle of rows, and their sums
rolled up to all shallower prefixes; what still overflows goes to the next pass. Rows look their leaf up in the directory, which has an entry for a cell, not for a row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

BITS, STEP = 60, 8
#: Entries of a directory's level that are broadcast at most, of some forty bytes each.
ENTRIES = 200_000
LIMIT = 32 << 20


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _hash() -> Column:
    """60 hash bits of a row's id and text. A null id hashes as empty text, a null text as empty."""
    name = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(_text().cast("binary"))).cast("binary"))
    return F.conv(F.substring(name, 1, 15), 16, 10).cast("long")


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, bytes and hash bits x of each row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(_text()).cast("long").alias("bytes"), _hash().alias("x"))


def directory(scratch: Scratch, rows: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """The directory for rows (bytes, x), by levels: how many bits index a level, and its entries (cell, leaf), a leaf being depth, prefix, total and over.

    A leaf's bytes sum to at most limit. over are leaves of one hash that has more: no further bit divides them. What a level has no entry for is in the next.
    """
    levels, base, waiting = [], 0, rows.select("bytes", "x")
    while True:
        deep = min(base + STEP, BITS)
        cell = F.shiftright("x", BITS - deep)
        cells = scratch.write(waiting.groupBy(cell.alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("most")), "cells")
        depths = cells.withColumn("depth", F.explode(F.expr(f"sequence({base}, {deep})"))).withColumn("prefix", F.expr(f"shiftright(cell, {deep} - depth)"))
        sums = depths.groupBy("depth", "prefix").agg(F.sum("bytes").alias("total"), F.sum("n").alias("rows"), F.min("least").alias("least"), F.max("most").alias("most"))
        fits = F.col("total").between(0, limit) | (F.col("rows") == 1)
        equal = F.col("least") == F.col("most")
        leaf = depths.select("cell", "depth", "prefix").join(sums.where(fits | equal), ["depth", "prefix"]).groupBy("cell").agg(F.min_by(F.struct("depth", "prefix", "total", (~fits).alias("over")), "depth").alias("leaf"))
        leaf = scratch.write(leaf, "leaves")
        levels.append((deep, leaf))
        if deep == BITS or cells.join(leaf, "cell", "left_anti").isEmpty():  # with all bits, a cell is one hash
            return levels
        waiting, base = waiting.join(_sized(leaf.select(F.col("cell").alias("_cell"))), cell == F.col("_cell"), "left_anti"), deep


def _sized(entries: DataFrame) -> DataFrame:
    """A level's entries, broadcast where they are few; AQE splits the join where they are not."""
    return F.broadcast(entries) if entries.count() <= ENTRIES else entries


def _placed(scratch: Scratch, rows: DataFrame, levels: list[tuple[int, DataFrame]], limit: int) -> DataFrame:
    """rows (doc_id, bytes, x and others) with depth, prefix, part, shard, shard_bytes.

    Rows of a bucket that no bit divides are counted off into parts that fit: numbered within each input partition first, so that no task sees a
    hot group whole. `tie`, a hash of the row, makes the numbers the same whenever a task runs again.
    """
    own = ["depth", "prefix", "part", "shard_bytes"]
    every, found = rows, []
    for k, (deep, leaf) in enumerate(levels):
        every = every.join(_sized(leaf.select(F.col("cell").alias(f"_cell{k}"), F.col("leaf").alias(f"_leaf{k}"))), F.shiftright("x", BITS - deep) == F.col(f"_cell{k}"), "left")
        found.append(F.col(f"_leaf{k}"))
    every = every.withColumn("leaf", F.coalesce(*found)).select(*rows.columns, "leaf.*")
    plain = every.where("not over").withColumns({"part": F.lit(0).cast("long"), "shard_bytes": F.col("total")})
    over = scratch.write(every.where("over"), "over")
    if over.isEmpty():
        placed = plain.select(*rows.columns, *own)
    else:
        like = ["x", "doc_id", "bytes"]
        over = over.withColumn("at", F.spark_partition_id())
        per = F.greatest(F.lit(1), F.expr(f"{limit} div greatest(bytes, 1)")).cast("long")
        counts = scratch.write(over.groupBy(*like, "at").agg(F.count("*").alias("n")), "counts")
        before = counts.withColumns({"before": F.sum("n").over(Window.partitionBy(*like).orderBy("at")) - F.col("n")})
        groups = counts.groupBy(*like).agg(F.sum("n").alias("all")).withColumn("per", per).withColumn("parts", F.expr("(all + per - 1) div per"))
        groups = groups.withColumn("first", F.sum("parts").over(Window.partitionBy("x").orderBy(F.col("doc_id").asc_nulls_first(), "bytes")) - F.col("parts"))
        # Null ids meet as such.
        name = F.struct(*like)
        number = F.row_number().over(Window.partitionBy(name, "at").orderBy("tie")) - 1
        told = before.select(name.alias("like"), F.col("at").alias("where"), "before").join(groups.select(name.alias("like"), "all", "per", "first"), "like")
        counted = over.withColumn("number", number).join(told, (name == F.col("like")) & (F.col("at") == F.col("where")))
        k = F.expr("(number + before) div per")
        counted = counted.withColumns({"part": F.col("first") + k, "shard_bytes": F.col("bytes") * F.least("per", F.col("all") - k * F.col("per"))})
        placed = plain.select(*rows.columns, *own).union(counted.select(*rows.columns, *own))
    shard = F.concat_ws("-", F.col("depth").cast("string"), F.col("prefix").cast("string"), F.when(F.col("part") > 0, F.col("part").cast("string")))
    return placed.withColumn("shard", shard)


def assign(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, bytes, depth, prefix, part, shard, shard_bytes, x.

    A shard is the `depth` first hash bits, as the number `prefix`; its texts' UTF-8 bytes sum to at most limit. A text over the limit is alone in its
    shard. Rows equal in id and text share all bits: if together they overflow, they are counted off into parts that fit. Empty and null texts have no
    bytes and are placed like others; extra columns are not read; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    rows = scratch.write(hashed(docs).withColumn("tie", F.lit(0)), "hashed")
    return _placed(scratch, rows, directory(scratch, rows, limit), limit).select("doc_id", "bytes", "depth", "prefix", "part", "shard", "shard_bytes", "x")


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Writes every row of docs (doc_id, text and others), all columns as they are, below path, a folder _shard=... for each shard of assign().

    Repeated rows are written as often as they come. A column of docs named _shard is refused, for the folders' name would hide it.
    """
    if "_shard" in [c.lower() for c in docs.columns]:
        raise ValueError("docs has a column named _shard")
    scratch = Scratch(docs.sparkSession, "shards")
    rows = scratch.write(hashed(docs), "hashed")
    levels = directory(scratch, rows, limit)
    plain = [f.name for f in docs.schema.fields if f.dataType.typeName() != "map"]
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(_text()).cast("long").alias("bytes"), _hash().alias("x"), F.xxhash64(*[F.col(f"`{c}`") for c in plain]).alias("tie"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    placed = _placed(scratch, whole, levels, limit).select("row.*", F.col("shard").alias("_shard"))
    placed.repartition("_shard").write.partitionBy("_shard").parquet(path)


def oracle(limit: int = LIMIT) -> str:
    """assign() without x in the SQL of the correctness check, for rows that do not repeat."""
    return f"""
        WITH h AS (SELECT doc_id, strlen(coalesce(text, '')) AS bytes,
            ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS x FROM documents),
        p AS (SELECT *, x >> (60 - depth) AS prefix FROM h, (SELECT unnest(range(0, 61)) AS depth)),
        t AS (SELECT *, sum(bytes) OVER g AS total, count(*) OVER g AS n FROM p WINDOW g AS (PARTITION BY depth, prefix)),
        f AS (SELECT * FROM t WHERE total <= {limit} OR n = 1 QUALIFY row_number() OVER (PARTITION BY doc_id, x ORDER BY depth) = 1)
        SELECT doc_id, bytes, depth, prefix, 0 AS part, depth || '-' || prefix AS shard, CAST(total AS BIGINT) AS shard_bytes FROM f"""
