"""Work queues as folds of an append-only log of attempts. No row is locked: a job's state is a function of its events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks


def enqueue(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new whose natural_key no job has; of several with one key the first by id."""
    first = new.withColumn("_rn", F.row_number().over(Window.partitionBy("natural_key").orderBy("id"))).where("_rn = 1").drop("_rn")
    return first.join(jobs.select("natural_key"), "natural_key", "left_anti").select(*new.columns)


def claim(jobs: DataFrame, limit: int, kinds: list[str] | None = None) -> DataFrame:
    """The next pending jobs of each (session, kind), first come first: at most limit, running, with one attempt more."""
    some = jobs.where("status = 'pending'")
    some = some.where(F.col("kind").isin(kinds)) if kinds else some
    place = F.row_number().over(Window.partitionBy("session_id", "kind").orderBy("id"))
    return some.withColumn("place", place).where(F.col("place") <= limit).withColumns({"status": F.lit("running"), "attempts": F.col("attempts") + 1})


MAX_ATTEMPTS = 5
STATE = "struct<status:string,attempts:int,cost:double>"


def step(state: Column, event: Column, cost: Column, max_attempts: int = MAX_ATTEMPTS) -> Column:
    """A job's state (status, attempts, cost) after an event; the one rule for batches and streams.

    claim takes a pending job and starts an attempt; complete and fail end a job whatever its state, and cost; release gives a running job's attempt back without
    cost; reap ends it. A failed or reaped job whose attempts are used up is dead, else pending. Other events change nothing.
    """
    pending, running = state["status"] == "pending", state["status"] == "running"
    ended = F.when(state["attempts"] >= max_attempts, "dead").otherwise("pending")
    status = F.when(pending & (event == "claim"), "running").when(event == "complete", "done").when(running & (event == "release"), "pending").when((event == "fail") | (running & (event == "reap")), ended).otherwise(state["status"])
    attempts = F.when(pending & (event == "claim"), state["attempts"] + 1).when(running & (event == "release"), F.greatest(state["attempts"] - 1, F.lit(0))).otherwise(state["attempts"])
    paid = F.when(event.isin("complete", "fail"), F.coalesce(cost, F.lit(0.0))).otherwise(0.0)
    return F.struct(status.alias("status"), attempts.cast("int").alias("attempts"), (state["cost"] + paid).alias("cost")).cast(STATE)


def fold(events: DataFrame, max_attempts: int = MAX_ATTEMPTS, few: bool = False) -> DataFrame:
    """State of each job from its events (job, id, event, cost) in order of id: status, attempts, cost, by step().

    Events are dealt in ranges of (job, id), so a job with a third of all events is cut into as many stretches as ranges hold it, and none is gathered whole. The
    first stretch of a job is folded from its start; a later one from each state that it could begin in, of which the stretches' own order picks one. With `few`, where
    a log bounds the events of a job as attempts do, each job is folded whole.
    """
    start = F.struct(F.lit("pending").alias("status"), F.lit(0).alias("attempts"), F.lit(0.0).alias("cost")).cast(STATE)
    walked = lambda begin: F.aggregate("events", begin, lambda s, e: step(s, e["event"], e["cost"], max_attempts))
    if few:
        held = events.groupBy("job").agg(F.sort_array(F.collect_list(F.struct("id", "event", F.col("cost").cast("double").alias("cost")))).alias("events"))
        return held.select("job", walked(start).alias("s")).select("job", "s.status", "s.attempts", "s.cost")
    every = [F.struct(F.lit(s).alias("status"), F.lit(a).alias("attempts"), F.lit(0.0).alias("cost")).cast(STATE) for s in ("pending", "running", "done", "dead") for a in range(max_attempts + 1)]
    ranged = events.select("job", "id", "event", F.col("cost").cast("double").alias("cost")).repartitionByRange("job", "id").withColumn("stretch", F.spark_partition_id())
    held = ranged.groupBy("job", "stretch").agg(F.sort_array(F.collect_list(F.struct("id", "event", "cost"))).alias("events"))
    first = F.row_number().over(Window.partitionBy("job").orderBy("stretch")) == 1
    ends = held.withColumn("first", first).select("job", "stretch", F.when(F.col("first"), F.array(walked(start))).otherwise(F.transform(F.array(*every), walked)).alias("ends"))

    def follow(state, x):
        place = F.array_position(F.array(*[F.lit(s) for s in ("pending", "running", "done", "dead")]), state["status"]).cast("int") - 1
        end = F.when(F.size(x["ends"]) == 1, x["ends"][0]).otherwise(F.get(x["ends"], place * (max_attempts + 1) + state["attempts"]))
        return F.struct(end["status"].alias("status"), end["attempts"].alias("attempts"), (state["cost"] + end["cost"]).alias("cost")).cast(STATE)

    joined = ends.groupBy("job").agg(F.sort_array(F.collect_list(F.struct("stretch", "ends"))).alias("stretches"))
    return joined.select("job", F.aggregate("stretches", start, follow).alias("s")).select("job", "s.status", "s.attempts", "s.cost")


def reap(jobs: DataFrame, now: Column, stale_seconds: int = 900, max_attempts: int = 5) -> DataFrame:
    """Running jobs locked before now - stale go back, or die with their attempts used up."""
    stale = (F.col("status") == "running") & (F.col("locked_at") < now - F.expr(f"interval {stale_seconds} seconds"))
    return jobs.withColumn("status", F.when(stale & (F.col("attempts") >= max_attempts), "dead").when(stale, "pending").otherwise(F.col("status")))


def batches(jobs: DataFrame, size: int = 250) -> DataFrame:
    """done jobs without a batch, dealt in id order into batches of a session: batch number from 0. A session may be as large as it likes."""
    ready = jobs.where("status = 'done' and batch_id is null")
    return ranks.running(ready, [F.col("id").asc()], name="_n", by=["session_id"]).withColumn("batch", F.floor((F.col("_n") - 1) / size).cast("long")).drop("_n")


def reconcile(ledger: DataFrame, stored: DataFrame) -> DataFrame:
    """Each unresolved batch (collection, batch_id, expected) against what its own collection holds: committed, absent or partial."""
    found = stored.groupBy("collection", "batch_id").agg(F.count("*").alias("found"))
    out = ledger.join(found, ["collection", "batch_id"], "left").withColumn("found", F.coalesce("found", F.lit(0)))
    verdict = F.when(F.col("found") == F.col("expected"), "committed").when(F.col("found") == 0, "absent").otherwise("partial")
    return out.withColumn("verdict", verdict)


def within_budget(claims: DataFrame, budget: Column) -> DataFrame:
    """Claims (session_id, id, cost) that are still made: the budget is looked at before each, so the last one may go over it."""
    cost = F.coalesce(F.col("cost"), F.lit(0.0))
    spent = ranks.running(claims, [F.col("id").asc()], cost, "_upto", ["session_id"])
    return spent.withColumn("spent_before", F.col("_upto") - cost).drop("_upto").where(F.col("spent_before") < budget)


def images_ready(images: DataFrame) -> DataFrame:
    """For image jobs (entity, role, ref_role, status): what to do next, by the state of the image they build on.

    ready with its base attached, wait while the base is open, alone if the base is dead or there is none; base images are first.
    """
    base = images.select(F.col("entity").alias("entity"), F.col("role").alias("ref_role"), F.col("status").alias("base_status"), F.col("path").alias("base_path"))
    out = images.join(base, ["entity", "ref_role"], "left")
    step = F.when(F.col("ref_role").isNull(), "alone").when(F.col("base_status") == "done", "ready").when(F.col("base_status").isNull() | (F.col("base_status") == "dead"), "alone").otherwise("wait")
    return out.withColumn("step", step).orderBy(F.col("ref_role").isNotNull(), "entity", "role")


def error_class(status: Column, body: Column) -> Column:
    """How a failed call is treated: region, quota, rate, server, credentials, other."""
    low = F.lower(F.coalesce(body, F.lit("")))
    return F.when(low.contains("region") | low.contains("country"), "region").when(low.contains("quota") | low.contains("insufficient"), "quota").when(status == 429, "rate").when(status >= 500, "server").when(status.isin(401, 403), "credentials").otherwise("other")


def retried(kind: Column, idempotent: Column) -> Column:
    """Calls that may be repeated: a rate limit always, a server's error only where repeating does no harm."""
    return (kind == "rate") | ((kind == "server") & idempotent)


def ledger(entries: DataFrame) -> DataFrame:
    """Current state of each batch from an append-only ledger (id, batch_id, collection, expected, status, error): the last entry's, and how often it was inflight."""
    return entries.groupBy("batch_id").agg(F.max_by(F.struct("collection", "expected", "status", "error"), "id").alias("x"), F.count_if(F.col("status") == "inflight").alias("attempts")).select("batch_id", "x.*", "attempts")


def unresolved(batches: DataFrame) -> DataFrame:
    """Batches whose outcome is not known: each belongs to its own collection and is held against that alone."""
    return batches.where("status in ('unknown', 'inflight')")


def resolution(reconciled: DataFrame) -> DataFrame:
    """What follows from a batch's verdict: its next status, whether its jobs go back to be batched anew, and whether what landed of it is deleted first."""
    v = F.col("verdict")
    return reconciled.withColumns({"next": F.when(v == "committed", "committed").otherwise("failed"), "detach": v != "committed", "delete": v == "partial"})


def detached(jobs: DataFrame, batches: DataFrame) -> DataFrame:
    """jobs with no batch where theirs is one of batches (batch_id)."""
    gone = batches.select(F.col("batch_id").alias("_gone")).distinct()
    return jobs.join(gone, F.col("batch_id") == F.col("_gone"), "left").withColumn("batch_id", F.when(F.col("_gone").isNull(), F.col("batch_id"))).drop("_gone")


def chunks(claimed: DataFrame, size: int = 4) -> DataFrame:
    """Claimed jobs with the round of `size` jobs of their session that works on them."""
    return ranks.running(claimed, [F.col("id").asc()], name="_n", by=["session_id"]).withColumn("chunk", F.floor((F.col("_n") - 1) / size).cast("long")).drop("_n")


def next_state(status: Column, spent: Column, budget: Column, fatal: Column, settled: Column) -> Column:
    """A session between claims: paused stays, a fatal error fails it, a spent budget pauses it, settled work ends it."""
    return F.when(status == "paused", "paused").when(fatal, "failed").when(F.coalesce(spent >= budget, F.lit(False)), "paused").when(settled, "done").otherwise("running")


def backoff(attempt: Column, base: float = 0.5, most: float = 30.0, hinted: Column | None = None) -> Column:
    """Seconds to wait before a call is repeated: doubled each time up to a bound, or what the server asked for."""
    own = F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), attempt))
    return F.coalesce(hinted, own) if hinted is not None else own
