"""What the corpus operators share: tables, the shared scratch folder, Arrow views of text, graph components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Scratch:
    """Tables written below the folder that the cluster names in spark.checkpoint.dir.

    A written table cuts lineage and survives lost executors. Only where the setting is
    absent and the session is local, as in tests, is a folder of our own made.
    """

    #: Folders made by this process, in order.
    made: list[str] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        if base is None:
            if not spark.sparkContext.master.split("[")[0] == "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="muster-")
        self.root = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.made.append(self.root)

    @classmethod
    def clear(cls, spark: SparkSession, since: int) -> None:
        """Deletes the folders made from that number on, whose tables nothing reads any more."""
        for root in cls.made[since:]:
            path = spark._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        del cls.made[since:]

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{name}-{self.count}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        self.release()
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def release(self) -> None:
        """Spark removes the shuffle files of a finished step once its driver-side objects are collected; this asks for that now."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, df: DataFrame) -> None:
        """Deletes a table of ours that no later step reads."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def trim() -> None:
    """Gives back to the system what this worker has freed: it lives on for other stages, beside workers of theirs."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def trimmed(run):
    """run for mapInArrow, with trim() after each task."""

    @wraps(run)
    def whole(batches):
        yield from run(batches)
        trim()

    return whole


def bytes_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and each row's bounds in them; null is empty. No copy of the bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(batch: pa.RecordBatch, most: int = 1 << 22):
    """The batch in runs of rows with at most so many bytes of text, a longer text alone, so memory follows no batch size."""
    size = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(size, size[begin] + most, side="right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def groups(batches, keys: list[str]):
    """Joins a sorted stream of batches into one table for each run of equal keys."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        rows = list(zip(*columns, strict=True))
        begin = 0
        for i, row in enumerate(rows):
            if row != last:
                if i > begin:
                    held.append(batch.slice(begin, i - begin))
                if held:
                    yield last, pa.Table.from_batches(held)
                held, begin, last = [], i, row
        held.append(batch.slice(begin))
    if held:
        yield last, pa.Table.from_batches(held)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): a row (node, label) for each node, label the least node.

    Large-star and small-star steps in turn until nothing changes. Each step is a grouped minimum, combined before its shuffle and written,
    and an equi-join of two tables, which AQE splits where a node is hot; nothing is gathered in one task.
    """
    now = scratch.write(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    seen = None

    def with_least(pairs: DataFrame):
        least = scratch.write(pairs.groupBy("a").agg(F.min("b").alias("m")), "least")
        return least, pairs.join(least, "a")

    while True:
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            break
        seen = mark
        first, both = with_least(now.union(now.select("b", "a")))
        large = scratch.write(both.where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct(), "large")
        second, joined = with_least(large)
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(second.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        then = scratch.write(small, "edges")
        for old in (now, first, large, second):
            scratch.drop(old)
        now = then
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select("b", "b").distinct())
