"""Profiles of columns, feedback, progress, cost and estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranks


def numeric_profile(df: DataFrame, column: str) -> DataFrame:
    """n, min, p10, median, p90, max, mean: q(f) is the value at place round((n - 1) f) of the sorted ones. Of no values n is 0 and the rest null."""
    x = F.col(column).cast("double")
    _, values = ranks.select(df, x, lambda n: [ranks.rounded((n - 1) * f) for f in (0.1, 0.5, 0.9)])
    p10, median, p90 = (F.lit(v).cast("double") for v in values or [None] * 3)
    return df.where(x.isNotNull()).agg(F.count("*").alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean")).select("n", "min", p10.alias("p10"), median.alias("median"), p90.alias("p90"), "max", "mean")


def bool_profile(df: DataFrame, column: str) -> DataFrame:
    """share: how many of all rows are true; null counts as false, no rows as 0."""
    return df.agg(F.coalesce(F.avg(F.coalesce(F.col(column), F.lit(False)).cast("int")), F.lit(0.0)).alias("share"))


def histogram(df: DataFrame, column: str) -> DataFrame:
    """bin, n: one bin if all are equal, else 2 to 10 by the range; bin = round((x - lo) / (hi - lo) * (bins - 1))."""
    x = F.col(column).cast("double")
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).select("*", F.when(F.col("hi") == F.col("lo"), 1).otherwise(F.greatest(F.lit(2), F.least(F.lit(10), F.floor(F.col("hi") - F.col("lo")) + 1))).alias("bins")).first()
    if ends["lo"] is None:
        return df.sparkSession.createDataFrame([], "bin long, n long")
    place = F.lit(0) if ends["bins"] == 1 else F.round((x - ends["lo"]) / (ends["hi"] - ends["lo"]) * (ends["bins"] - 1))
    return df.where(x.isNotNull()).groupBy(place.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def category_profile(df: DataFrame, column: str, top: int | None = 25) -> DataFrame:
    """value, n, share of all rows, distinct: the most frequent values, ties by value; all of them where top is None."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).where("value is not null")
    total, distinct = df.agg(F.count("*").alias("total")), counts.agg(F.count("*").alias("distinct"))
    some = counts if top is None else counts.orderBy(F.desc("n"), "value").limit(top)
    return some.join(F.broadcast(total)).join(F.broadcast(distinct)).select("value", "n", (F.col("n") / F.col("total")).alias("share"), "distinct")


def list_profile(df: DataFrame, column: str) -> DataFrame:
    """item, share of all rows that list it, mean length of the lists."""
    total = df.agg(F.count("*").alias("total"), F.avg(F.size(column)).alias("mean_length"))
    items = df.select(F.explode(F.array_distinct(column)).alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    return items.join(F.broadcast(total)).select("item", (F.col("n") / F.col("total")).alias("share"), "mean_length")


def progress(jobs: DataFrame, group: str = "session_id") -> DataFrame:
    """Counts by status with zeros, sums of cost and tokens, whether all is settled, and percent."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    out = jobs.groupBy(group).agg(*[is_(s).alias(s) for s in ("pending", "running", "done", "failed", "dead")], F.count("*").alias("total"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    return out.withColumns({"settled": (F.col("pending") == 0) & (F.col("running") == 0) & (F.col("failed") == 0), "percent": F.when(F.col("total") > 0, (F.col("done") + F.col("dead")) / F.col("total")).otherwise(0.0)})


def feedback(marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of marks (verdict, tags as a JSON list): (good, bad, reject_rate) and (tag, n). Malformed tags are none; a tag twice in a mark counts twice."""
    good, bad = F.count_if(F.col("verdict") == "good"), F.count_if(F.col("verdict") == "bad")
    rates = marks.agg(good.alias("good"), bad.alias("bad")).withColumn("reject_rate", F.coalesce(F.try_divide(F.col("bad"), F.col("good") + F.col("bad")), F.lit(0.0)))
    tags = marks.where("verdict in ('good', 'bad')").select(F.explode(F.from_json("tags", "array<string>")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    return rates, tags


def systemic_tags(marks: DataFrame, least: int = 3, min_share: float = 0.15) -> DataFrame:
    """tag, n, share of marks, for tags that are no accident; most frequent first, ties by tag."""
    total = marks.where("verdict in ('good', 'bad')").agg(F.count("*").alias("marks"))
    tags = feedback(marks)[1].join(F.broadcast(total)).select("tag", "n", (F.col("n") / F.col("marks")).alias("share"))
    return tags.where((F.col("n") >= least) & (F.col("share") >= min_share)).orderBy(F.desc("n"), "tag")


def cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Prices are per million tokens."""
    return tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out


def mean_cost(jobs: DataFrame) -> DataFrame:
    return jobs.where("status = 'done'").groupBy("kind").agg(F.avg("cost").alias("mean_cost"))


def estimate(count: int, images: int, mean_text: Column, image_price: Column, text_prior: float = 0.0006, image_prior: float = 0.04) -> Column:
    """Cost of a run: texts at their mean cost so far, images at their price, priors where there is none."""
    return F.lit(count) * (F.coalesce(mean_text, F.lit(text_prior)) + F.lit(images) * F.coalesce(image_price, F.lit(image_prior)))


def eta(elapsed: Column, finished: Column, left: Column) -> Column:
    """Seconds to go; null before anything is finished."""
    return F.try_divide(elapsed, finished) * left


def variation_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """Half the sum of |p - q| of two distributions (value, share)."""
    both = a.select("value", F.col("share").alias("p")).join(b.select("value", F.col("share").alias("q")), "value", "full")
    return both.agg((F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))) / 2).alias("distance"))
