"""What a user calls: runs, previews, reports. Each returns a frame and starts no server."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import profiles, sampling, similarity
from .plans.dictionary import Dictionary, check_spec, issues


def plan(spark: SparkSession, d: Dictionary, n: int, session: str, kind: str, seed: int = 2026, cohorts: list[dict] | None = None, constraints: list[dict] | None = None) -> DataFrame:
    """Rows of a run with their natural keys; the request is checked first."""
    if wrong := check_spec(d, cohorts or [], constraints or []):
        raise ValueError("; ".join(wrong))
    rows = sampling.population(spark, d, n, seed, cohorts, constraints)
    return rows.withColumn("natural_key", sampling.natural_key(kind, F.lit(session), F.col("idx")))


def preview(spark: SparkSession, d: Dictionary, n: int = 1000, seed: int = 2026) -> dict[str, DataFrame]:
    """The profile of each parameter over a sample of 10 to 5000 rows."""
    if not 10 <= n <= 5000:
        raise ValueError("a preview takes 10 to 5000 rows")
    rows = sampling.population(spark, d, n, seed)
    make = {"int": profiles.numeric_profile, "float": profiles.numeric_profile, "computed": profiles.numeric_profile, "multi_enum": profiles.list_profile, "bool": profiles.bool_profile, "derived": None}
    return {p["key"]: f(rows, p["key"]) for p in d.params if (f := make.get(p["domain"]["type"], profiles.category_profile))}


def dictionary_report(d: Dictionary) -> dict:
    return {"params": d.params, "issues": issues(d)}


def sessions_report(sessions: DataFrame, jobs: DataFrame) -> DataFrame:
    """Runs, newest first, with their progress."""
    return sessions.join(profiles.progress(jobs), sessions["id"] == F.col("session_id"), "left").orderBy(F.desc("created_at"), "id")


def activity(jobs: DataFrame, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """The latest done jobs and the latest with an error."""
    last = lambda df: df.orderBy(F.desc("updated_at"), F.desc("id")).limit(n)
    return last(jobs.where("status = 'done'")), last(jobs.where("last_error is not null"))


def mark(target: str, verdict: str, tags: list[str], comment: str = "") -> dict:
    """A checked annotation: a bad one says why."""
    if verdict not in ("good", "bad"):
        raise ValueError("a verdict is good or bad")
    if verdict == "bad" and not tags:
        raise ValueError("a bad verdict needs tags")
    return {"target": target, "verdict": verdict, "tags": tags, "comment": comment}


def similarity_report(docs: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """How near each text is to its nearest: the summary, and the five nearest pairs, each once."""
    s = similarity.sets(docs, key)
    near = similarity.neighbours(s, s, 1)
    pairs = near.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "score").distinct()
    return similarity.summary(near, F.col("score")), pairs.orderBy(F.desc("score"), "a", "b").limit(5)


def marks(store, session: str | None = None) -> dict[str, DataFrame]:
    """Annotations with their jobs' keys, counts and rates, and the tags that are no accident."""
    found = store.annotations(session)
    rates, tags = profiles.feedback(found)
    return {"annotations": found, "rates": rates, "tags": tags.orderBy(F.desc("n"), "tag"), "systemic": profiles.systemic_tags(found)}


def progress(store, session: str) -> dict:
    """Counts, cost and the seconds to go of a session: elapsed since it began, shared by what is finished."""
    found, s = store.progress(session), store.session(session)
    finished, left = found["done"] + found["dead"], found["pending"] + found["running"]
    elapsed = (store.clock() - s["created_at"]) / 1000
    return found | {"status": s["status"], "spent": s["spent"], "budget": s["budget"], "eta": elapsed / finished * left if finished else None}


def watch(store, session: str, seconds: float = 0.7, sleep=time.sleep):
    """A session's progress again and again, until nothing is left to do or it stands still by pause or failure."""
    while True:
        now = progress(store, session)
        yield now
        if now["settled"] or now["status"] in ("paused", "failed", "done"):
            return
        sleep(seconds)


def quote(store, kind: str, count: int, images: int = 0, image_price: float | None = None) -> float:
    """What a run will cost: by the mean of finished jobs of its kind, or the priors."""
    row = profiles.mean_cost(store.jobs().where(F.col("kind") == kind)).first()
    one = row["mean_cost"] if row and row["mean_cost"] is not None else 0.0006
    return count * (one + images * (image_price if image_price is not None else 0.04))


def show(store, session: str, limit: int = 3) -> DataFrame:
    """The first finished records of a session with their files."""
    files = store.assets().groupBy(F.col("entity_key").alias("natural_key")).agg(F.sort_array(F.collect_list(F.struct("role", "path"))).alias("images"))
    done = store.jobs(session).where("result is not null").orderBy("id").limit(limit)
    return done.join(files, "natural_key", "left").select("id", "natural_key", F.col("result").alias("record"), "images").orderBy("id")


def collections(local: dict[str, DataFrame], remote: dict[str, DataFrame]) -> DataFrame:
    """pool, local, remote: how many rows each collection has here and there."""
    a, b = census(local).withColumnRenamed("n", "local"), census(remote).withColumnRenamed("n", "remote")
    return a.join(b, "pool", "full").select("pool", F.coalesce("local", F.lit(0)).alias("local"), F.coalesce("remote", F.lit(0)).alias("remote"))


def census(pools: dict[str, DataFrame]) -> DataFrame:
    """How many rows each pool has."""
    out = None
    for name, df in pools.items():
        n = df.agg(F.lit(name).alias("pool"), F.count("*").alias("n"))
        out = n if out is None else out.union(n)
    return out

