"""Runs: rows become texts, texts are accepted or not, accepted ones are written in batches. Every step is a frame; the loop between claims is the driver's."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import acceptance, prompts, queue, sampling, similarity
from .operators.lineage import cut
from .plans.dictionary import Dictionary, check_spec
from .store import Store

ANSWER = "id long, text string, tokens_in long, tokens_out long, cost double, error string, fatal boolean"


class TextModel(Protocol):
    """Answers requests (JSON texts). It goes to the workers, so it must pickle. An answer: text, tokens_in, tokens_out, cost, or error and whether that is fatal."""

    def complete(self, requests: list[str]) -> list[dict]: ...


class ImageModel(Protocol):
    """Draws images of prompts, some with an image to build on; the bytes of each, None where it cannot. It goes to the workers, so it must pickle."""

    def render(self, prompts: list[str], bases: list[bytes | None]) -> list[bytes | None]: ...


class ContentStore(Protocol):
    """Where records go. write gives committed or unknown; verify says how many of a batch are there."""

    def ensure(self, collection: str) -> None: ...

    def write(self, collection: str, batch_id: str, records: DataFrame) -> str: ...

    def verify(self, collection: str, batch_id: str) -> int: ...

    def delete(self, collection: str, batch_id: str) -> None: ...

    def count(self, collection: str) -> int: ...


@dataclass
class Generator:
    """A domain: its dictionary, what it asks for, what it accepts, and what a record is."""

    kind: str
    collection: str
    title: str
    dictionary: Dictionary
    policy: acceptance.Policy
    schema: str = "{}"
    roles: list[tuple[str, str, str | None]] = field(default_factory=list)
    full_names: Callable[[DataFrame], DataFrame] | None = None  # rows (idx, ...) to (idx, full_name)

    def plan(self, spark: SparkSession, spec: dict, session: str) -> DataFrame:
        """natural_key and payload of a run's rows: the parameters, with names where the domain has them, and the cohort."""
        if wrong := check_spec(self.dictionary, spec.get("cohorts", []), spec.get("constraints", []), spec.get("threshold")):
            raise ValueError("; ".join(wrong))
        rows = sampling.population(spark, self.dictionary, spec["count"], spec.get("seed", 2026), spec.get("cohorts"), spec.get("constraints"))
        if self.full_names:
            names = self.full_names(rows).select("idx", F.col("full_name").alias("_name"))
            rows = rows.drop("full_name").join(names, "idx", "left").withColumnRenamed("_name", "full_name")
        return rows.orderBy("idx").select(self.natural_key(session).alias("natural_key"), F.to_json(F.struct(*[c for c in rows.columns if c not in ("idx", "attempt")])).alias("payload"))

    def natural_key(self, session: str):
        return sampling.natural_key(self.kind, F.lit(session), F.col("idx"))

    def rows(self, jobs: DataFrame) -> DataFrame:
        """Jobs with their parameters as columns."""
        return jobs.withColumn("_p", F.from_json("payload", self.dictionary.schema() + ", cohort string, full_name string" * ("full_name" not in {p["key"] for p in self.dictionary.params}))).select(*[c for c in jobs.columns if c != "payload"], "_p.*")

    def text_requests(self, jobs: DataFrame, brief: str = "") -> DataFrame:
        return self.rows(jobs).select("id", prompts.request(self.dictionary, brief, self.schema).alias("request"))

    def image_requests(self, jobs: DataFrame) -> DataFrame:
        return prompts.image_requests(self.rows(jobs), self.dictionary, self.roles)

    def accept(self, jobs: DataFrame, answers: DataFrame) -> DataFrame:
        """id, natural_key, the fields, reject_kind, reject_reason, unique_text of answered jobs."""
        return acceptance.judged(self.rows(jobs).join(answers.select("id", F.col("text").alias("answer")), "id"), self.policy)

    def assemble(self, accepted: DataFrame):
        """A record as JSON: parameters that are not null, the texts, the kind."""
        left_out = {"id", "natural_key", "session_id", "kind", "answer", "reject_kind", "reject_reason", "unique_text"}
        fields = [c for c in accepted.columns if c not in left_out and c not in self.policy.echoes]
        return F.to_json(F.struct(*fields, F.lit(self.kind).alias("entity_kind")))


def answered(requests: DataFrame, model: TextModel, at_once: int = 4) -> DataFrame:
    """Answers of requests (id, request), some at once in each task."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for begin in range(0, len(part), at_once):
                some = part.iloc[begin : begin + at_once]
                found = model.complete(some["request"].tolist())
                blank = {"text": None, "tokens_in": 0, "tokens_out": 0, "cost": 0.0, "error": None, "fatal": False}
                yield pd.DataFrame([blank | a for a in found]).assign(id=some["id"].to_numpy())[[c.split()[0] for c in ANSWER.split(", ")]]

    return requests.mapInPandas(run, ANSWER)


class Fake:
    """A model that makes the same answer of a request each time, for tests and rehearsals. make: from a request to the answer's text."""

    def __init__(self, make: Callable[[dict], str], cost: float = 0.001, fatal_after: int | None = None):
        self.make, self.cost, self.fatal_after = make, cost, fatal_after

    def complete(self, requests: list[str]) -> list[dict]:
        out = []
        for r in requests:
            text = self.make(json.loads(r))
            out.append({"text": text, "tokens_in": len(r), "tokens_out": len(text), "cost": self.cost} if text is not None else {"error": "no answer", "fatal": self.fatal_after is not None})
        return out

    def render(self, prompts_: list[str], bases: list[bytes | None]) -> list[bytes | None]:
        return [b"\x89PNG" + p.encode()[:64] + (base or b"")[:8] for p, base in zip(prompts_, bases, strict=True)]


def start(store: Store, generator: Generator, spec: dict) -> str:
    """A session with its jobs."""
    session = store.start(generator.kind, spec, spec.get("seed", 2026), spec.get("budget_usd"))
    store.set_status(session, "planning")
    store.enqueue(session, text_kind(generator), generator.plan(store.spark, spec, session))
    store.set_status(session, "running")
    return session


def text_kind(generator: Generator) -> str:
    return f"{generator.kind}:text"


def run(store: Store, generator: Generator, session: str, model: TextModel, brief: str = "", claim: int = 16, at_once: int = 4) -> dict:
    """Works on a session until nothing is left, it is paused, its budget is spent, or an error is fatal; its progress. It can be called again and goes on.

    Pauses and the budget are looked at between claims, so begun work is finished and the last claim may go over the budget. Answers that are rejected cost, too.
    """
    store.reap()
    s = store.session(session)
    if s["status"] == "failed":
        store.set_status(session, "running")
    spec = json.loads(s["spec"])
    threshold, scope = spec.get("threshold"), spec.get("scope", "collection")
    while True:
        s = store.session(session)
        if s["status"] == "paused":
            return store.progress(session)
        if s["budget"] is not None and s["spent"] >= s["budget"]:
            store.set_status(session, "paused")
            break
        jobs = store.claim(session, text_kind(generator), claim).persist()
        if jobs.isEmpty():
            break
        answers = answered(generator.text_requests(jobs, brief), model, at_once).persist()
        judged = generator.accept(jobs, answers.where("error is null"))
        if threshold:
            base = similarity.sets(_accepted_before(store, generator, None if scope == "collection" else session), "natural_key", "unique_text")
            new = judged.where("reject_reason is null and unique_text is not null")
            standing = similarity.unique(similarity.sets(new, "id", "unique_text"), threshold, base).where("not accepted").select("id", F.lit("too close to another text").alias("_close"))
            judged = judged.join(standing, "id", "left").withColumn("reject_reason", F.coalesce("reject_reason", "_close")).drop("_close")
        verdicts = judged.select("id", "reject_reason", generator.assemble(judged).alias("record"))
        events = answers.join(verdicts, "id", "left").select(
            F.col("id").alias("job"), F.when(F.col("error").isNull() & F.col("reject_reason").isNull(), "complete").otherwise("fail").alias("event"), "cost", "tokens_in", "tokens_out",
            F.coalesce("error", "reject_reason").alias("error"), F.when(F.col("error").isNull() & F.col("reject_reason").isNull(), F.col("record")).alias("result"),
        )
        store.record(events)
        fatal = not answers.where("fatal").isEmpty()
        answers.unpersist()
        jobs.unpersist()
        if fatal:
            store.set_status(session, "failed")
            return store.progress(session)
    done = store.progress(session)
    if done["settled"]:
        store.set_status(session, "done")
    return done


def _accepted_before(store: Store, generator: Generator, session: str | None) -> DataFrame:
    """natural_key and unique_text of the accepted texts of a kind."""
    done = store.jobs(session).where((F.col("kind") == text_kind(generator)) & (F.col("status") == "done") & F.col("result").isNotNull())
    compared = generator.policy.unique or [f for f, n in generator.policy.fields.items() if n >= 100]
    return done.select("natural_key", F.concat_ws(" ", *[F.get_json_object("result", f"$.{f}") for f in compared]).alias("unique_text"))


def records(store: Store, jobs: DataFrame, session: str) -> DataFrame:
    """What a batch writes: natural_key, session_id, record and the entity's files."""
    files = store.assets().groupBy(F.col("entity_key").alias("natural_key")).agg(F.sort_array(F.collect_list(F.struct("role", "path"))).alias("images"))
    return jobs.select("natural_key", F.lit(session).alias("session_id"), F.col("result").alias("record")).join(files, "natural_key", "left")


def flush(store: Store, generator: Generator, session: str, content: ContentStore, size: int = 250, attempts: int = 3) -> int:
    """Writes what is done in batches; how many records were written. A batch whose outcome is unknown is not written again before it is held against the store.

    A write that keeps failing ends after as many batches as attempts.
    """
    content.ensure(generator.collection)
    resolve(store, generator.collection, content)
    written = failed = 0
    while failed < attempts and (opened := store.open_batch(session, generator.collection, text_kind(generator), size)):
        name, jobs = opened
        rows = records(store, jobs, session)
        n = rows.count()
        store.set_batch(name, "inflight")
        try:
            outcome = content.write(generator.collection, name, rows)
        except Exception as e:
            store.set_batch(name, "failed", str(e))
            store.detach(name)
            failed += 1
            continue
        store.set_batch(name, outcome)
        written += n if outcome == "committed" else 0
    return written


def resolve(store: Store, collection: str, content: ContentStore) -> None:
    """Holds batches of unknown outcome against the store: whole ones are committed, absent ones go back, partial ones are deleted and go back."""
    open_ = store.unresolved(collection).select("batch_id", "expected").collect()  # a row a batch in doubt, which are few
    for b in open_:
        found = content.verify(collection, b["batch_id"])
        if found == b["expected"]:
            store.set_batch(b["batch_id"], "committed")
            continue
        if found:
            content.delete(collection, b["batch_id"])
        store.detach(b["batch_id"])
        store.set_batch(b["batch_id"], "failed", "absent" if not found else f"partial: {found}")


class Files:
    """A content store of Parquet folders, one for each batch."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, collection: str, batch_id: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{collection}" + (f"/batch_id={batch_id}" if batch_id else ""))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def ensure(self, collection: str) -> None:
        path, fs = self._path(collection)
        fs.mkdirs(path)

    def write(self, collection: str, batch_id: str, records: DataFrame) -> str:
        records.write.mode("overwrite").parquet(f"{self.root}/{collection}/batch_id={batch_id}")
        return "committed"

    def verify(self, collection: str, batch_id: str) -> int:
        path, fs = self._path(collection, batch_id)
        return self.spark.read.parquet(f"{self.root}/{collection}/batch_id={batch_id}").count() if fs.exists(path) else 0

    def delete(self, collection: str, batch_id: str) -> None:
        path, fs = self._path(collection, batch_id)
        fs.delete(path, True)

    def count(self, collection: str) -> int:
        path, fs = self._path(collection)
        return self.spark.read.parquet(f"{self.root}/{collection}").count() if fs.exists(path) and fs.listStatus(path) else 0


def rendered(asked: DataFrame, model: ImageModel, at_once: int = 4) -> DataFrame:
    """entity, role, data, status of image jobs (entity, role, prompt, base): done, or dead where the model gave none or failed."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for begin in range(0, len(part), at_once):
                some = part.iloc[begin : begin + at_once]
                try:
                    data = model.render(some["prompt"].tolist(), [None if b is None else bytes(b) for b in some["base"]])
                except Exception:
                    data = [None] * len(some)
                yield pd.DataFrame({"entity": some["entity"].to_numpy(), "role": some["role"].to_numpy(), "data": data, "status": ["dead" if d is None else "done" for d in data]})

    return asked.select("entity", "role", "prompt", "base").mapInPandas(run, "entity string, role string, data binary, status string")


def draw_images(requests: DataFrame, model: ImageModel) -> DataFrame:
    """entity, role, step, data, status of image requests (entity, role, prompt, ref_role), each as queue.images_ready says.

    Bases first: an image whose base is drawn gets it with its prompt, one whose base is dead or was never asked for is drawn alone. There are as many passes as roles build on one another;
    roles in a circle are never drawn and stay pending.
    """
    requests = cut(requests.select(F.col("entity").cast("string").alias("entity"), "role", "prompt", "ref_role"))
    done = None
    while True:
        state = requests.withColumns({"status": F.lit("pending"), "path": F.lit(None).cast("string"), "data": F.lit(None).cast("binary"), "step": F.lit(None).cast("string")})
        if done is not None:
            state = requests.join(done, ["entity", "role"], "left").withColumns({"status": F.coalesce("status", F.lit("pending")), "path": F.lit(None).cast("string")})
        steps = queue.images_ready(state.drop("step")).where("status = 'pending' and step in ('ready', 'alone')")
        base = state.select("entity", F.col("role").alias("ref_role"), F.col("data").alias("base"))
        asked = cut(steps.select("entity", "role", "prompt", "ref_role", "step").join(base, ["entity", "ref_role"], "left").withColumn("base", F.when(F.col("step") == "ready", F.col("base"))))
        if asked.isEmpty():
            return state.select("entity", "role", "step", "data", "status")
        new = rendered(asked, model).join(asked.select("entity", "role", "step"), ["entity", "role"])
        done = cut(new if done is None else done.unionByName(new))


