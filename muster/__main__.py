"""python -m muster STORE COMMAND ...: runs in a store's folder, their reports and controls, and work on pools, texts and photos; one JSON object a line."""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import api, domains, engine
from .operators import compose, media
from .plans import dictionary
from .sources import records
from .store import Store

# Pools of a composition, as JSON lines in files of a folder.
POOLS = {
    "places": "key string, segment string, region string, capacity int, year_built int",
    "programs": "key string, segment string, focus string",
    "people": "key string, role string, full_name string, age int, fits map<string,double>, specialist boolean, psychiatric boolean",
    "directors": "key string, full_name string, age int, home_region string, founder boolean, leading_years int",
}


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="muster", description=__doc__)
    top.add_argument("store")
    some = top.add_subparsers(dest="command", required=True)
    some.add_parser("sessions")
    for name in ("progress", "pause", "resume", "watch", "feedback"):
        some.add_parser(name).add_argument("session")
    show = some.add_parser("show")
    show.add_argument("session")
    show.add_argument("--limit", type=int, default=3)
    mark = some.add_parser("mark")
    for name in ("session", "target", "verdict"):
        mark.add_argument(name)
    mark.add_argument("--tag", action="append", default=[])
    mark.add_argument("--comment", default="")
    quote = some.add_parser("quote")
    quote.add_argument("kind")
    quote.add_argument("count", type=int)
    quote.add_argument("--images", type=int, default=0)
    for name in ("plan", "run", "upload"):
        on = some.add_parser(name)
        if name != "plan":
            on.add_argument("session")
        on.add_argument("kind", choices=[*domains.ROLES, *domains.THINGS])
        on.add_argument("dictionary")
        if name == "plan":
            on.add_argument("count", type=int)
            on.add_argument("--seed", type=int, default=2026)
            on.add_argument("--budget", type=float)
            on.add_argument("--threshold", type=float)
        elif name == "run":
            on.add_argument("model", help="module:name of what gives a TextModel when it is called")
            on.add_argument("--brief", default="")
        else:
            on.add_argument("root")
    near = some.add_parser("similarity")
    near.add_argument("texts", help="JSON lines of id and text")
    made = some.add_parser("compose")
    made.add_argument("pools", help="a folder of " + ", ".join(f"{x}.jsonl" for x in POOLS))
    made.add_argument("out")
    made.add_argument("--count", type=int)
    made.add_argument("--shards", type=int, default=1)
    made.add_argument("--seed", type=int, default=compose.YEAR)
    linked = some.add_parser("photos")
    for name in ("records", "map", "out"):
        linked.add_argument(name)
    again = some.add_parser("refinish")
    again.add_argument("images", help="a folder of PNG files")
    again.add_argument("out")
    again.add_argument("--seed", type=int, default=2026)
    check = some.add_parser("check")
    check.add_argument("dictionary")
    preview = some.add_parser("preview")
    preview.add_argument("dictionary")
    preview.add_argument("--n", type=int, default=200)
    return top


def _domain(a) -> engine.Generator:
    d = dictionary.load(a.dictionary)
    return domains.person(a.kind, d) if a.kind in domains.ROLES else domains.thing(a.kind, d)


def run(spark: SparkSession, words: list[str], out=sys.stdout) -> None:
    a = _parser().parse_args(words)
    store = Store(spark, a.store)

    def say(**x):
        print(json.dumps(x, ensure_ascii=False, default=str), file=out)

    def rows(df, **more):
        for r in df.collect():  # reports of a few rows
            say(**more, **r.asDict(recursive=True))

    if a.command == "sessions":
        rows(api.sessions_report(store.sessions().withColumnRenamed("session_id", "id"), store.jobs()))
    elif a.command == "progress":
        say(**api.progress(store, a.session))
    elif a.command == "watch":
        for now in api.watch(store, a.session):
            say(**now)
    elif a.command in ("pause", "resume"):
        getattr(store, a.command)(a.session)
        say(**api.progress(store, a.session))
    elif a.command == "feedback":
        found = api.marks(store, a.session)
        for name in ("rates", "tags", "systemic"):
            rows(found[name], of=name)
    elif a.command == "show":
        rows(api.show(store, a.session, a.limit))
    elif a.command == "mark":
        store.annotate(a.session, a.target, a.verdict, a.tag, a.comment)
    elif a.command == "quote":
        say(cost=api.quote(store, a.kind, a.count, a.images))
    elif a.command == "plan":
        spec = {"count": a.count, "seed": a.seed} | {k: v for k, v in (("budget_usd", a.budget), ("threshold", a.threshold)) if v is not None}
        session = engine.start(store, _domain(a), spec)
        say(session=session, **api.progress(store, session))
    elif a.command == "run":
        module, _, name = a.model.partition(":")
        engine.run(store, _domain(a), a.session, getattr(importlib.import_module(module), name)(), a.brief)
        say(**api.progress(store, a.session))
    elif a.command == "upload":
        say(written=engine.flush(store, _domain(a), a.session, engine.Files(spark, a.root)))
    elif a.command == "similarity":
        found, nearest = api.similarity_report(records.read_jsonl(spark, a.texts, "id string, text string").where("id is not null"), "id")
        rows(found)
        rows(nearest)
    elif a.command == "compose":
        pools = [records.read_jsonl(spark, f"{a.pools}/{name}.jsonl", schema) for name, schema in POOLS.items()]
        centres = compose.compose(*pools, compose.Rules(), a.seed, a.count, shards=a.shards).where("place is not null").drop("short")
        centres.write.mode("errorifexists").json(a.out)
        say(centres=spark.read.json(a.out).count())
    elif a.command == "photos":
        given = spark.read.json(a.records)
        given = given if "photo" in given.columns else given.withColumn("photo", F.lit(None).cast("string"))
        records.with_photos(given, records.photo_map(spark, a.map)).write.mode("errorifexists").json(a.out)
        rows(spark.read.json(a.out).agg(F.count("*").alias("records"), F.count("photo").alias("with_photo")))
    elif a.command == "refinish":
        images = spark.read.format("binaryFile").load(a.images).select(F.element_at(F.split("path", "/"), -1).alias("key"), F.col("content").alias("data"))
        media.finish(images, a.seed).write.mode("errorifexists").parquet(a.out)
        rows(spark.read.parquet(a.out).agg(F.count_if(F.col("error").isNull()).alias("finished"), F.count("error").alias("refused")))
    elif a.command == "check":
        say(issues=dictionary.issues(dictionary.load(a.dictionary, check=False)))
    elif a.command == "preview":
        for key, df in api.preview(spark, dictionary.load(a.dictionary), a.n).items():
            rows(df, key=key)


if __name__ == "__main__":
    run(SparkSession.builder.getOrCreate(), sys.argv[1:])
