"""Places and running sums over a whole table, without bringing it to one task."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def running(df: DataFrame, order: list[Column], amount: Column | None = None, name: str = "upto", by: list[str] | None = None) -> DataFrame:
    """df with the sum of amount (or the number of rows) up to and with each row, of all rows or those alike in `by`, in an order that must be total.

    Rows are dealt in ranges of (by, order) and written, so that no group is one task's; sums within a range are a window of its own. What the ranges before have
    of a group comes from a table of the groups that begin in an earlier range than they go on in: a row a range at most.
    """
    by = by or []
    own = amount if amount is not None else F.lit(1).cast("long")
    ranged = cut(df.repartitionByRange(*by, *order).withColumns({"_range": F.spark_partition_id(), "_own": own}))
    sums = ranged.groupBy("_range", *by).agg(F.sum("_own").alias("_sum"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_range", *by, F.sum("_sum").over(earlier).alias("_before")).where("_before is not null")
    inside = F.sum("_own").over(Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    given = F.broadcast(before.select(F.col("_range").alias("_in"), F.struct(*by, F.lit(0)).alias("_of"), "_before"))
    met = ranged.withColumn(name, inside).join(given, (F.col("_range") == F.col("_in")) & F.struct(*by, F.lit(0)).eqNullSafe(F.col("_of")), "left")
    return met.withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).drop("_range", "_own", "_in", "_of", "_before")


def seeded(column: str, seed: int) -> list[Column]:
    """An order by a hash of the seed and a key."""
    return [F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(column).cast("string")).cast("binary")).asc(), F.col(column).asc()]


#: Bins of a round of select().
BINS = 1024


def select(df: DataFrame, x: Column, places: Callable[[int], list[int]]) -> tuple[int, list]:
    """How many values x has (nulls apart), and the values at places (of that number, from 0) of them sorted, NaN last.

    Nothing is sorted or moved: each round counts values in BINS bins between a range's ends, in every task first, and goes on with the bin that holds the place, between its
    least and greatest value. A round narrows a range by the number of bins; where values pile up it takes a few more. All places go on together.
    """
    rows = df.select(x.cast("double").alias("x")).where("x is not null")
    finite = ~F.isnan("x") & (F.abs("x") != float("inf"))
    n, below, inside, infinite, low, high = rows.agg(
        F.count("*"), F.count_if(F.col("x") == float("-inf")), F.count_if(finite), F.count_if(F.col("x") == float("inf")), F.min(F.when(finite, F.col("x"))), F.max(F.when(finite, F.col("x")))
    ).first()
    asked = places(n) if n else []
    found: dict[int, float] = {}
    open_: dict[int, tuple] = {}  # by place: the range's ends, and how many values come before it
    for place in set(asked):
        at = place - below
        if at < 0:
            found[place] = float("-inf")
        elif at >= inside:
            found[place] = float("inf") if at < inside + infinite else float("nan")
        else:
            open_[place] = (low, high, below)
    while open_:
        for place, (low, high, _) in list(open_.items()):
            if low == high:
                found[place] = low
                del open_[place]
        ranges = sorted({r[:2] for r in open_.values()})
        if not ranges:
            break
        one = None
        for k, (low, high) in enumerate(ranges):
            share = (F.col("x") / 2 - low / 2) / (high / 2 - low / 2)
            cell = F.struct(F.lit(k).alias("k"), F.floor(share * (BINS - 1)).cast("int").alias("bin"))
            part = F.when(F.col("x").between(low, high) & finite, F.array(cell)).otherwise(F.array().cast("array<struct<k:int,bin:int>>"))
            one = part if one is None else F.concat(one, part)
        counts = rows.select("x", F.explode(one).alias("c")).groupBy("c.k", "c.bin").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()
        for place, (low, high, before) in list(open_.items()):
            k = ranges.index((low, high))
            for r in sorted((r for r in counts if r["k"] == k), key=lambda r: r["bin"]):
                if place < before + r["n"]:
                    open_[place] = (r["low"], r["high"], before)
                    break
                before += r["n"]
    return n, [found[p] for p in asked]


def rounded(x: float) -> int:
    """Half away from zero, of what is not negative."""
    return math.floor(x + 0.5)
