"""The operational store of runs: append-only Parquet logs and the states that they fold to.

Nothing is updated in place. A claim, an answer, a batch's outcome, an annotation are rows; what a job, a session or a batch is now is a query. One process writes to
a session at a time, as one driver does; readers see whole appends only.
"""

from __future__ import annotations

import hashlib
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import profiles, queue

TABLES = {
    "sessions": "id long, session_id string, kind string, spec string, status string, seed long, budget double, ts long",
    "jobs": "id long, session_id string, kind string, natural_key string, payload string",
    "events": "id long, job long, event string, cost double, tokens_in long, tokens_out long, error string, result string, worker string, ts long",
    "batches": "id long, batch_id string, session_id string, collection string, expected long, status string, error string, ts long",
    "batched": "id long, job long, batch_id string",
    "annotations": "id long, session_id string, job long, target string, asset string, verdict string, tags string, comment string, author string, ts long",
    "assets": "id long, session_id string, entity_key string, job long, role string, path string, bytes long, cost double, ts long",
}
SESSION_STATES = ("pending", "planning", "running", "paused", "failed", "done")


class Store:
    def __init__(self, spark: SparkSession, root: str, clock=lambda: int(time.time() * 1000)):
        self.spark, self.root, self.clock = spark, root.rstrip("/"), clock

    def read(self, name: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{name}")

    def append(self, name: str, rows: DataFrame) -> None:
        """Adds rows, in their order, after all that the table has; missing columns are null."""
        last = self.read(name).agg(F.max("id")).first()[0]
        fields = [f.split() for f in TABLES[name].split(", ")]
        numbered = rows.withColumn("id", F.monotonically_increasing_id() + F.lit(0 if last is None else last + 1))
        shaped = numbered.select(*[(F.col(c) if c in numbered.columns else F.lit(None)).cast(kind).alias(c) for c, kind in fields])
        shaped.write.mode("append").parquet(f"{self.root}/{name}")

    def put(self, name: str, **values) -> None:
        """Adds one row."""
        known = [(k, kind) for k, kind in (f.split() for f in TABLES[name].split(", ")) if k in values]
        self.append(name, self.spark.createDataFrame([tuple(values[k] for k, _ in known)], ", ".join(f"{k} {t}" for k, t in known)))

    # ---- sessions

    def start(self, kind: str, spec: dict, seed: int = 2026, budget: float | None = None) -> str:
        """The session of a specification: the same one for the same request, so a repeated start adds nothing."""
        text = json.dumps(spec, sort_keys=True, ensure_ascii=False)
        name = hashlib.sha256(f"{kind}|{seed}|{text}".encode()).hexdigest()[:16]
        if self.session(name) is None:
            self.put("sessions", session_id=name, kind=kind, spec=text, status="pending", seed=seed, budget=budget, ts=self.clock())
        return name

    def sessions(self) -> DataFrame:
        """session_id, kind, spec, status, seed, budget, created_at, updated_at, spent."""
        rows = self.read("sessions")
        now = rows.groupBy("session_id").agg(F.max_by(F.struct("kind", "spec", "status", "seed", "budget"), "id").alias("x"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"))
        spent = self.read("events").join(self.read("jobs").select(F.col("id").alias("job"), "session_id"), "job").where("event in ('complete', 'fail')").groupBy("session_id").agg(F.sum("cost").alias("spent"))
        return now.join(spent, "session_id", "left").select("session_id", "x.*", "created_at", "updated_at", F.coalesce("spent", F.lit(0.0)).alias("spent"))

    def session(self, name: str):
        return self.sessions().where(F.col("session_id") == name).first()

    def set_status(self, name: str, status: str) -> None:
        if status not in SESSION_STATES:
            raise ValueError(f"a session is one of {', '.join(SESSION_STATES)}")
        s = self.session(name)
        self.put("sessions", session_id=name, kind=s["kind"], spec=s["spec"], status=status, seed=s["seed"], budget=s["budget"], ts=self.clock())

    def pause(self, name: str) -> None:
        self.set_status(name, "paused")

    def resume(self, name: str) -> None:
        self.set_status(name, "running")

    # ---- jobs

    def enqueue(self, session: str, kind: str, rows: DataFrame) -> int:
        """Adds jobs (natural_key, payload) whose key no job has; how many were added."""
        held = self.read("jobs")
        new = queue.enqueue(held, rows.withColumn("id", F.monotonically_increasing_id())).orderBy("id").drop("id")
        before = held.count()
        self.append("jobs", new.withColumns({"session_id": F.lit(session), "kind": F.lit(kind)}))
        return self.read("jobs").count() - before

    def jobs(self, session: str | None = None) -> DataFrame:
        """Jobs with status, attempts, cost, tokens, locked_at, locked_by, last_error, result, updated_at, batch_id."""
        jobs = self.read("jobs")
        jobs = jobs.where(F.col("session_id") == session) if session else jobs
        events = self.read("events").join(jobs.select(F.col("id").alias("job")), "job", "left_semi")
        state = queue.fold(events.select("job", "id", "event", "cost"), few=True)  # attempts bound a job's events
        paid = F.col("event").isin("complete", "fail")
        facts = events.groupBy("job").agg(
            F.coalesce(F.sum(F.when(paid, F.col("tokens_in"))), F.lit(0)).alias("tokens_in"),
            F.coalesce(F.sum(F.when(paid, F.col("tokens_out"))), F.lit(0)).alias("tokens_out"),
            F.max_by(F.struct("event", "error", "worker", "ts"), "id").alias("last"),
            F.max_by("result", F.when(F.col("event") == "complete", F.col("id"))).alias("result"),
            F.max("ts").alias("updated_at"),
        )
        batch = self.read("batched").groupBy("job").agg(F.max_by(F.struct("batch_id"), "id").alias("b"))
        out = jobs.withColumnRenamed("id", "job").join(state, "job", "left").join(facts, "job", "left").join(batch, "job", "left")
        running = F.col("status") == "running"
        return out.select(
            F.col("job").alias("id"), "session_id", "kind", "natural_key", "payload",
            F.coalesce("status", F.lit("pending")).alias("status"), F.coalesce("attempts", F.lit(0)).alias("attempts"), F.coalesce("cost", F.lit(0.0)).alias("cost"),
            (F.coalesce("tokens_in", F.lit(0)) + F.coalesce("tokens_out", F.lit(0))).alias("tokens"),
            F.when(running, F.col("last.ts")).alias("locked_at"), F.when(running, F.col("last.worker")).alias("locked_by"),
            F.when(F.coalesce("status", F.lit("pending")) != "done", F.col("last.error")).alias("last_error"),
            F.when(F.col("status") == "done", F.col("result")).alias("result"), "updated_at", F.col("b.batch_id").alias("batch_id"),
        )

    def claim(self, session: str, kind: str, limit: int, worker: str = "w") -> DataFrame:
        """The next pending jobs of a kind, first come first, now running."""
        found = queue.claim(self.jobs(session), limit, [kind]).select("id", "natural_key", "payload")
        at = self.clock()
        before = self.read("events").agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0]
        self.append("events", found.select(F.col("id").alias("job"), F.lit("claim").alias("event"), F.lit(worker).alias("worker"), F.lit(at).alias("ts")))
        mine = self.read("events").where(F.col("id") > before).select(F.col("job").alias("id"))
        return self.read("jobs").join(mine, "id", "left_semi")

    def record(self, events: DataFrame) -> None:
        """Adds events (job, event, cost, tokens_in, tokens_out, error, result)."""
        self.append("events", events.withColumn("ts", F.lit(self.clock())))

    def reap(self, stale_ms: int = 900_000) -> int:
        """Running jobs locked before now - stale go back to the queue, or die with their attempts used up."""
        stale = self.jobs().where((F.col("status") == "running") & (F.col("locked_at") < self.clock() - stale_ms)).select(F.col("id").alias("job"), F.lit("reap").alias("event"), F.lit("the lock is stale").alias("error"))
        n = stale.count()
        if n:
            self.record(stale)
        return n

    def progress(self, session: str):
        """Counts by status, sums of cost and tokens, whether all is settled, percent."""
        found = profiles.progress(self.jobs(session)).first()
        return found.asDict() if found else {"session_id": session, "total": 0, "settled": True, "percent": 0.0, "cost": 0.0, "tokens": 0} | dict.fromkeys(("pending", "running", "done", "failed", "dead"), 0)

    # ---- batches

    def open_batch(self, session: str, collection: str, kind: str, size: int = 250) -> tuple[str, DataFrame] | None:
        """The next done jobs without a batch, tagged with a new one; none where there are none."""
        jobs = self.jobs(session).where(F.col("kind") == kind)
        some = jobs.where("status = 'done' and batch_id is null").orderBy("id").limit(size).select("id")
        n = some.count()
        if not n:
            return None
        name = hashlib.sha256(f"{session}|{collection}|{self.read('batches').count()}|{self.clock()}".encode()).hexdigest()[:16]
        self.append("batched", some.select(F.col("id").alias("job"), F.lit(name).alias("batch_id")))
        self.put("batches", batch_id=name, session_id=session, collection=collection, expected=n, status="pending", ts=self.clock())
        return name, self.jobs(session).where(F.col("batch_id") == name)

    def set_batch(self, batch_id: str, status: str, error: str | None = None) -> None:
        last = self.read("batches").where(F.col("batch_id") == batch_id).orderBy(F.desc("id")).first()
        self.put("batches", batch_id=batch_id, session_id=last["session_id"], collection=last["collection"], expected=last["expected"], status=status, error=error, ts=self.clock())

    def batches(self) -> DataFrame:
        return queue.ledger(self.read("batches"))

    def unresolved(self, collection: str) -> DataFrame:
        """Batches of one collection whose outcome is not known."""
        return queue.unresolved(self.batches()).where(F.col("collection") == collection)

    def detach(self, batch_id: str) -> None:
        """Its jobs have no batch any more."""
        held = self.read("batched").groupBy("job").agg(F.max_by("batch_id", "id").alias("b")).where(F.col("b") == batch_id)
        self.append("batched", held.select("job"))

    # ---- annotations and assets

    def annotate(self, session: str, target: str, verdict: str, tags: list[str], comment: str = "", author: str = "", asset: str | None = None) -> None:
        """A verdict on a record. A bad one says why."""
        if verdict not in ("good", "bad"):
            raise ValueError("a verdict is good or bad")
        if verdict == "bad" and not tags:
            raise ValueError("a bad verdict needs tags")
        job = self.read("jobs").where(F.col("natural_key") == target).first()
        self.put("annotations", session_id=session, job=job["id"] if job else None, target=target, asset=asset, verdict=verdict, tags=json.dumps(tags, ensure_ascii=False), comment=comment, author=author, ts=self.clock())

    def annotations(self, session: str | None = None) -> DataFrame:
        """Annotations in order, with the key of the job that they are on."""
        out = self.read("annotations")
        out = out.where(F.col("session_id") == session) if session else out
        return out.join(self.read("jobs").select(F.col("id").alias("job"), F.col("natural_key").alias("job_key")), "job", "left").orderBy("id")

    def add_assets(self, rows: DataFrame) -> None:
        """Files (session_id, entity_key, job, role, path, bytes, cost) of entities."""
        self.append("assets", rows.withColumn("ts", F.lit(self.clock())))

    def assets(self) -> DataFrame:
        """The last file of each (entity_key, role)."""
        last = self.read("assets").groupBy("entity_key", "role").agg(F.max_by(F.struct("session_id", "job", "path", "bytes", "cost", "ts"), "id").alias("x"))
        return last.select("entity_key", "role", "x.*")
