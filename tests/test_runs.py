"""Stores, runs, streams, composition and sources, with fakes and scripted failures."""

import json
import random

import pytest
from pyspark.sql import functions as F

from muster import api, engine
from muster.functions import rules
from muster.functions import text as T
from muster.operators import acceptance, compose, queue, ranks, sampling, similarity
from muster.plans import dictionary
from muster.sources import records
from muster.store import Store
from muster.streaming import queue as streams

TOY = {
    "name": "toy",
    "params": [
        {"key": "age", "identity": True, "domain": {"kind": "int", "min": 25, "max": 60}},
        {"key": "town", "identity": True, "domain": {"kind": "enum", "variants": ["north", "south", "west"]}},
        {"key": "years", "identity": True, "domain": {"kind": "int", "min": 1, "max": 30}},
    ],
    "hard": [{"name": "grown", "expr": "years <= age - 20", "message": "too long at work"}],
    "soft": [{"name": "old", "when": "age >= 50", "then": [{"kind": "weight", "param": "town", "value": "south", "factor": 5}]}],
}


def _answer(request, unlucky=lambda text: False):
    said = request["user"]
    facts = dict(line.split(": ", 1) for line in said.splitlines() if ": " in line)
    if unlucky(said):
        return "nothing of use"
    return json.dumps({"bio": f"Somebody of {facts['age']} from the {facts['town']} of a long river, whose work fills {facts['years']} calm and busy days {hash_of(said)}", "stated": facts["age"]})


def hash_of(text):
    r = random.Random(text)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(12))


def _generator(**policy):
    return engine.Generator("person", "people", "People", dictionary.loads(json.dumps(TOY)), acceptance.Policy({"bio": 40}, ["nothing"], {"stated": "age"}, ["years"], age="age", unique=["bio"], latin_is_foreign=False, **policy))


@pytest.fixture()
def store(spark, tmp_path):
    clock = iter(range(1000, 10**9, 1000))
    return Store(spark, f"file://{tmp_path}/store", lambda: next(clock))


def test_a_run_from_plan_to_files(spark, store, tmp_path):
    g = _generator()
    session = engine.start(store, g, {"count": 6, "seed": 3, "threshold": 0.5})
    assert engine.start(store, g, {"count": 6, "seed": 3, "threshold": 0.5}) == session  # the same request is the same session
    done = engine.run(store, g, session, engine.Fake(_answer), claim=4)
    assert done["done"] == 6 and done["settled"] and abs(done["cost"] - 0.006) < 1e-9 and store.session(session)["status"] == "done"
    files = engine.Files(spark, f"file://{tmp_path}/out")
    assert engine.flush(store, g, session, files, size=4) == 6 and engine.flush(store, g, session, files) == 0
    assert files.count("people") == 6 and {b["status"] for b in store.batches().collect()} == {"committed"}
    record = json.loads(api.show(store, session, 1).first()["record"])
    assert record["entity_kind"] == "person" and "stated" not in record and {"age", "town", "years", "bio"} <= set(record)
    assert api.progress(store, session)["eta"] == 0 and abs(api.quote(store, "person:text", 10) - 0.01) < 1e-9


def test_commands(spark, tmp_path):
    import io

    from muster.__main__ import run

    store = Store(spark, f"file://{tmp_path}/store")
    g = _generator()
    session = engine.start(store, g, {"count": 2, "seed": 1})
    (tmp_path / "toy.json").write_text(json.dumps(TOY))

    def said(*words):
        out = io.StringIO()
        run(spark, [store.root, *words], out)
        return [json.loads(x) for x in out.getvalue().splitlines()]

    assert said("sessions")[0]["pending"] == 2 and said("pause", session)[0]["status"] == "paused" and [x["status"] for x in said("watch", session)] == ["paused"]
    assert said("resume", session)[0]["status"] == "running" and said("show", session) == [] and said("quote", "person:text", "10")[0]["cost"] == pytest.approx(0.006)
    key = store.jobs(session).first()["natural_key"]
    said("mark", session, key, "bad", "--tag", "dull")
    assert said("feedback", session)[0]["bad"] == 1 and said("check", str(tmp_path / "toy.json")) == [{"issues": []}]
    assert {x["key"] for x in said("preview", str(tmp_path / "toy.json"), "--n", "20")} == {"age", "town", "years"}


def test_images_of_a_frame(spark):
    import numpy as np

    from muster.operators import media

    image = np.random.default_rng(2).integers(0, 255, (20, 30, 3)).astype(np.uint8)
    data = media.write_png(image)
    assert (media.read_png(data) == image).all()
    df = spark.createDataFrame([("a", data), ("b", b"no image"), (None, None)], "key string, data binary")
    got = {r["key"]: r for r in media.finish(df, 3).collect()}
    assert (media.read_png(bytes(got["a"]["data"])) == media.finished(image, "a", 3)).all() and got["a"]["error"] is None
    assert got["b"]["error"] == "no PNG" and bytes(got["b"]["data"]) == b"no image" and got[None]["error"]


def test_rejected_answers_cost_and_die(store):
    g = _generator()
    session = engine.start(store, g, {"count": 2, "seed": 4})
    done = engine.run(store, g, session, engine.Fake(lambda r: "nothing of use"))
    jobs = store.jobs(session).collect()
    assert done["dead"] == 2 and {j["attempts"] for j in jobs} == {5} and abs(done["cost"] - 0.01) < 1e-9 and {j["last_error"] for j in jobs} == {"unparsed"}


def test_budget_pause_and_fatal_errors(store):
    g = _generator()
    session = engine.start(store, g, {"count": 8, "seed": 5, "budget_usd": 0.0035})
    done = engine.run(store, g, session, engine.Fake(_answer), claim=2)
    assert done["done"] == 4 and store.session(session)["status"] == "paused"  # a claim over the budget at most
    assert engine.run(store, g, session, engine.Fake(_answer))["done"] == 4  # paused stays paused
    other = engine.start(store, g, {"count": 3, "seed": 6})
    assert engine.run(store, g, other, engine.Fake(lambda r: None, fatal_after=0))["pending"] == 3 and store.session(other)["status"] == "failed"
    assert engine.run(store, g, other, engine.Fake(_answer))["done"] == 3  # a failed session goes on
    store.pause(other)
    assert store.session(other)["status"] == "paused"


def test_near_texts_are_rejected_in_order(store):
    g = _generator()
    session = engine.start(store, g, {"count": 2, "seed": 7, "threshold": 0.4})
    same = engine.Fake(lambda r: json.dumps({"bio": "the very same words about a calm life by the river and the sea in all seasons", "stated": dict(x.split(": ", 1) for x in r["user"].splitlines() if ": " in x)["age"]}))
    done = engine.run(store, g, session, same)
    assert done["done"] == 1 and done["dead"] == 1
    first = store.jobs(session).where("status = 'done'").first()
    assert first["id"] == min(j["id"] for j in store.jobs(session).collect())


class Lossy:
    """A content store whose writes land whole, in part or not at all without saying so."""

    def __init__(self, script):
        self.script, self.held = list(script), {}

    def ensure(self, collection):
        pass

    def write(self, collection, batch_id, rows):
        keys = [r["natural_key"] for r in rows.select("natural_key").collect()]
        how = self.script.pop(0) if self.script else "ok"
        if how == "error":
            raise OSError("refused")
        self.held[batch_id] = {"ok": keys, "landed": keys, "partial": keys[:1], "lost": []}[how]
        return "committed" if how == "ok" else "unknown"

    def verify(self, collection, batch_id):
        return len(self.held.get(batch_id, []))

    def delete(self, collection, batch_id):
        self.held.pop(batch_id, None)

    def count(self, collection):
        return sum(map(len, self.held.values()))


@pytest.mark.parametrize("how", ["landed", "partial", "lost", "error"])
def test_unknown_outcomes(store, how):
    g = _generator()
    session = engine.start(store, g, {"count": 3, "seed": 8})
    engine.run(store, g, session, engine.Fake(_answer))
    content = Lossy([how])
    engine.flush(store, g, session, content)
    engine.flush(store, g, session, content)
    assert content.count("people") == 3 and store.unresolved("people").isEmpty()
    assert sorted(k for keys in content.held.values() for k in keys) == sorted(j["natural_key"] for j in store.jobs(session).collect())


def test_a_store_that_always_refuses_ends(store):
    g = _generator()
    session = engine.start(store, g, {"count": 2, "seed": 9})
    engine.run(store, g, session, engine.Fake(_answer))
    assert engine.flush(store, g, session, Lossy(["error"] * 9), attempts=3) == 0 and store.jobs(session).where("batch_id is null").count() == 2


def test_claims_are_disjoint_and_stale_ones_come_back(spark, store):
    session = store.start("k", {})
    rows = spark.createDataFrame([(f"key{i:02d}", "{}") for i in range(20)], "natural_key string, payload string")
    assert store.enqueue(session, "k", rows) == 20 and store.enqueue(session, "k", rows) == 0
    a, b = ({r["id"] for r in store.claim(session, "k", 7).collect()} for _ in range(2))
    assert len(a) == len(b) == 7 and not a & b and max(a) < min(b)
    assert store.reap(stale_ms=10**12) == 0 and store.reap(stale_ms=0) == 14
    assert store.jobs(session).where("status = 'pending'").count() == 20


def test_marks(spark, store):
    session = store.start("k", {})
    store.enqueue(session, "k", spark.createDataFrame([("key", "{}")], "natural_key string, payload string"))
    for tags in (["gloomy"], ["gloomy", "dark"], ["gloomy"]):
        store.annotate(session, "key", "bad", tags)
    store.annotate(session, "elsewhere", "good", [])
    for verdict, tags in (("fine", ["x"]), ("bad", [])):
        with pytest.raises(ValueError):
            store.annotate(session, "key", verdict, tags)
    found = api.marks(store, session)
    assert [r["job_key"] for r in found["annotations"].collect()] == ["key"] * 3 + [None]
    assert found["rates"].first()["reject_rate"] == 0.75 and [(r["tag"], r["n"]) for r in found["systemic"].collect()] == [("gloomy", 3)]
    store.add_assets(spark.createDataFrame([(session, "key", "front", "a.png"), (session, "key", "front", "b.png")], "session_id string, entity_key string, role string, path string").coalesce(1))
    assert [r["path"] for r in store.assets().collect()] == ["b.png"]


# ---- queue: one rule for batches and streams


def _plain(events, most=5):
    state = ("pending", 0, 0.0)
    for event, cost in events:
        state = streams.after(state, event, cost, most)
    return state


def test_fold_is_the_stream_rule_also_for_a_hot_job(spark):
    r = random.Random(1)
    log, n = {j: [] for j in range(6)}, 0
    rows = []
    for _ in range(4000):
        j = 0 if r.random() < 0.7 else r.randrange(6)
        event, cost = r.choice(["claim", "claim", "release", "fail", "reap"] + ["complete"] * (r.random() < 0.02)), r.choice([None, 0.5])
        log[j].append((event, cost))
        rows.append((j, n, event, cost))
        n += 1
    r.shuffle(rows)
    events = spark.createDataFrame(rows, "job long, id long, event string, cost double")
    got = {x["job"]: (x["status"], x["attempts"], round(x["cost"], 6)) for x in queue.fold(events).collect()}
    assert got == {j: (s, a, round(c, 6)) for j, (s, a, c) in ((j, _plain(e)) for j, e in log.items())}


def test_streams(spark, tmp_path):
    src, out = tmp_path / "in", []
    rows = [(1, 1, "claim", 0.0, "2026-01-01 00:00:00"), (1, 2, "fail", 0.5, "2026-01-01 00:01:00"), (2, 3, "claim", 0.0, "2026-01-01 00:02:00")]
    late = [(1, 4, "claim", 0.0, "2026-01-01 03:00:00"), (1, 5, "complete", 0.5, "2026-01-01 03:01:00"), (3, 6, "claim", 0.0, "2026-01-01 05:00:00")]
    ddl = "job long, id long, event string, cost double, at string"
    for part in (rows, late, [(4, 7, "claim", 0.0, "2026-01-01 09:00:00")]):
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").json(str(src))
        events = spark.readStream.schema(ddl).json(str(src)).withColumn("ts", F.col("at").cast("timestamp")).drop("at")
        q = streams.folded(events).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda df, e: out.extend(df.collect())).trigger(availableNow=True).start()
        q.awaitTermination()
    last = {r["job"]: (r["status"], r["attempts"], r["cost"]) for r in out}
    assert last[1] == ("done", 2, 1.0) and last[2] == ("pending", 1, 0.0) and last[4] == ("running", 1, 0.0)


def test_intake_and_windows(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("a", "2026-01-01 00:10:00", 1, "x", 2.0), ("a", "2026-01-01 00:20:00", 1, "x", 3.0), ("b", "2026-01-01 01:10:00", 2, "y", 4.0)], "natural_key string, at string, user_id long, event_type string, value double").coalesce(1).write.json(str(src))
    read = lambda: spark.readStream.schema("natural_key string, at string, user_id long, event_type string, value double").json(str(src)).withColumn("ts", F.col("at").cast("timestamp"))
    for k, (made, mode) in enumerate([(streams.intake(read()), "append"), (streams.windowed(read()), "complete"), (streams.sessions(read()), "complete")]):
        found = []
        made.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / f"state{k}")).foreachBatch(lambda df, e, found=found: found.extend(df.collect())).trigger(availableNow=True).start().awaitTermination()
        assert len(found) == 2
        if k == 1:
            assert {(r["event_type"], r["n"], r["total"]) for r in found} == {("x", 2, 5.0), ("y", 1, 4.0)}


@pytest.mark.parametrize("script", [["ok"], ["partial", "ok"], ["raise", "ok"], ["land and raise"], ["raise", "raise", "raise"]])
def test_batched_sink(spark, script):
    held, log, left = {}, [], list(script)

    def write(df, name):
        how = left.pop(0)
        if how != "raise":
            held[name] = df.count() - (how == "partial")
        if "raise" in how:
            raise OSError(how)

    sink = streams.batched_sink(write, lambda n: held.get(n, 0), lambda n, k, s: log.append(s), lambda n: held.pop(n, None))
    df = spark.range(5)
    if script == ["raise"] * 3:
        with pytest.raises(RuntimeError):
            sink(df, 1)
        assert log[-1] == "failed"
        return
    sink(df, 1)
    assert held == {"epoch-1": 5} and log[-1] == "committed"
    sink(df, 1)  # a repeat writes nothing
    assert held == {"epoch-1": 5} and not left


# ---- composition


def _pools(spark, places=12, programs=24, people=90, directors=20, built=1980):
    r = random.Random(2)
    seg = ["low", "high"]
    p = spark.createDataFrame([(f"p{i}", seg[i % 2], f"r{i % 3}", 12 + i, built) for i in range(places)], "key string, segment string, region string, capacity int, year_built int")
    g = spark.createDataFrame([(f"g{i}", seg[i % 2], ["plain", "drink", "both"][i % 3]) for i in range(programs)], "key string, segment string, focus string")
    role = ["doctor", "psychologist", "consultant"]
    e = spark.createDataFrame([(f"e{i}", role[i % 3], f"Name{i % 29} {i}", 30 + r.randrange(35), {"plain": r.random(), "drink": r.random()}, i % 2 == 0, i % 5 == 0) for i in range(people)], "key string, role string, full_name string, age int, fits map<string,double>, specialist boolean, psychiatric boolean")
    d = spark.createDataFrame([(f"d{i}", f"Chief{i} X", 30 + 2 * i, f"r{i % 3}", i % 2 == 0, 5) for i in range(directors)], "key string, full_name string, age int, home_region string, founder boolean, leading_years int")
    return p, g, e, d


RULES = compose.Rules({"drink", "both"}, psychiatric_for={"both"}, founder_segments={"high"})


@pytest.mark.parametrize("shards", [1, 3])
def test_centres_keep_their_rules(spark, shards):
    pools = _pools(spark)
    places, programs, people, directors = ({r["key"]: r for r in x.collect()} for x in pools)
    out = compose.compose(*pools, RULES, seed=1, shards=shards).where("place is not null").collect()
    assert len(out) >= 4
    used = [k for c in out for k in (c["place"], c["program"], c["director"], *c["doctors"], *c["psychologists"], *c["consultants"])]
    assert len(used) == len(set(used))
    for c in out:
        place, team, chief = places[c["place"]], [people[k] for k in (*c["doctors"], *c["psychologists"], *c["consultants"])], directors[c["director"]]
        assert programs[c["program"]]["segment"] == place["segment"] == c["segment"] and programs[c["program"]]["focus"] == c["focus"]
        n = place["capacity"]
        assert (len(c["doctors"]), len(c["psychologists"]), len(c["consultants"])) == (min(3, 1 + n // 25), min(3, 1 + n // 20), min(7, 2 + n // 10))
        names = [T_root(x["full_name"]) for x in (*team, chief)]
        assert len(names) == len(set(names))
        if c["focus"] != "plain":
            assert any(people[k]["specialist"] for k in c["doctors"])
        if c["focus"] == "both":
            assert any(people[k]["psychiatric"] for k in c["doctors"])
        ages = sorted(x["age"] for x in team)
        assert c["median_age"] == ages[len(ages) // 2] and chief["age"] >= max(35, c["median_age"] - 8) and c["founded_year"] >= place["year_built"]
        fits = [x["fits"].get(c["focus"], 0.5) for x in team]
        assert abs(c["fit"] - sum(fits) / len(fits)) < 1e-9
    again = compose.compose(*[x.repartition(5) for x in pools], RULES, seed=1, shards=shards).where("place is not null").collect()
    assert {tuple(map(str, c)) for c in again} == {tuple(map(str, c)) for c in out}


def test_shards_leave_nothing_to_waste(spark):
    pools = _pools(spark)
    one = compose.compose(*pools, RULES, seed=1).where("place is not null").count()
    for shards in (3, 5):
        assert compose.compose(*pools, RULES, seed=1, shards=shards).where("place is not null").count() >= one
    assert compose.exactly(compose.compose(*pools, RULES, seed=1, count=one, shards=3), one).count() == one


def T_root(name):
    return name.split()[0].lower()


def test_shortages_name_their_pool(spark):
    places, programs, people, directors = _pools(spark)
    with pytest.raises(compose.Exhausted, match="doctor"):
        compose.exactly(compose.compose(places, programs, people.where("role != 'doctor'"), directors, RULES), 5)
    with pytest.raises(compose.Exhausted, match="director"):
        compose.exactly(compose.compose(*_pools(spark, directors=0), RULES), 5)
    with pytest.raises(compose.Exhausted, match="no place and programme"):
        compose.exactly(compose.compose(*_pools(spark, built=2030), RULES), 5)
    centres = compose.compose(*_pools(spark), RULES)
    some = compose.exactly(centres, 3)
    taken = compose.reserved(some)
    later = compose.compose(*_pools(spark), RULES, reserved=taken).where("place is not null")
    assert some.count() == 3 and compose.reserved(later).join(taken, "key").isEmpty()
    with pytest.raises(compose.Exhausted):
        compose.assign_names(some, spark.createDataFrame([("a",), ("b",)], "name string"), 1)


# ---- sampling, dictionaries


def test_dictionary_files(tmp_path):
    (tmp_path / "base.json").write_text("﻿" + json.dumps({"name": "base", "params": [{"key": "age", "identity": True, "domain": {"kind": "int", "min": 18, "max": 80}}, {"key": "x", "domain": {"kind": "bool", "p_true": 0.5}}], "hard": [{"name": "h", "expr": "age >= 18", "message": "m"}]}), encoding="utf-8")
    (tmp_path / "top.json").write_text(json.dumps({"extends": ["base.json"], "params": [{"key": "y", "domain": {"kind": "float", "min": 0, "max": 1}}, {"key": "age", "identity": True, "domain": {"kind": "int", "min": 30, "max": 40}}], "soft": [{"name": "s", "when": "x", "then": [{"kind": "range", "param": "y", "min": 0.5}]}]}))
    d = dictionary.load(str(tmp_path / "top.json"))
    assert [p["key"] for p in d.params] == ["age", "x", "y"] and d.param("age")["domain"]["min"] == 30 and len(d.hard) == len(d.soft) == 1
    assert dictionary.loads(d.dumps()).params == d.params
    for bad in ({"params": [], "rules": []}, {"params": [{"key": "a", "domain": {"kind": "int", "min": 1, "max": 2, "mean": 1}}]}, {"params": [{"key": "a", "domain": {"kind": "int", "min": 1, "max": 2}}], "soft": [{"name": "s", "when": "a", "then": [{"kind": "range", "of": "a"}]}]}):
        with pytest.raises(dictionary.DictionaryError, match="unknown"):
            dictionary.loads(json.dumps(bad))
    (tmp_path / "loop.json").write_text(json.dumps({"extends": ["loop"], "params": []}))
    with pytest.raises(dictionary.DictionaryError, match="deep"):
        dictionary.load(str(tmp_path / "loop.json"))


def test_budgets_of_the_sampler(spark, monkeypatch):
    one = lambda hard, high: dictionary.loads(json.dumps({"params": [{"key": "a", "identity": True, "domain": {"kind": "int", "min": 1, "max": high}}], "hard": hard}))
    with pytest.raises(sampling.Unsatisfiable, match="never"):
        sampling.population(spark, one([{"name": "often", "expr": "a >= 1"}, {"name": "never", "expr": "a > 9"}], 3), 2)
    monkeypatch.setattr(sampling, "UNIQUE_ATTEMPTS", 5)
    with pytest.raises(sampling.ExhaustedUniqueness):
        sampling.population(spark, one([], 3), 4)
    monkeypatch.setattr(sampling, "UNIQUE_ATTEMPTS", 60)
    rows = sampling.population(spark, one([{"name": "even", "expr": "a / 2 == 4 or a / 2 == 5 or a / 2 == 6"}], 60), 3).collect()  # a tight space is filled
    assert sorted(r["a"] for r in rows) == [8, 10, 12]


def test_a_large_dictionary(spark):
    """Seventy parameters whose soft rules look at one another: expressions grow with them, not as their powers."""
    r = random.Random(4)
    params = [{"key": "k0", "identity": True, "domain": {"kind": "int", "min": 1, "max": 500}}]
    soft, hard = [], []
    for k in range(1, 70):
        kind = k % 4
        domain = [{"kind": "enum", "variants": [{"value": f"v{i}", "weight": r.randint(1, 5)} for i in range(8)]}, {"kind": "int", "min": 0, "max": 50}, {"kind": "bool", "p_true": 0.4}, {"kind": "multi_enum", "variants": [f"m{i}" for i in range(6)], "min_pick": 1, "max_pick": 3}][kind]
        params.append({"key": f"k{k}", "domain": domain})
        for b in range(max(1, k - 9), k - 1, 4):
            when = [f"k{b} == 'v1'", f"k{b} > 25", f"k{b}", f"has(k{b}, 'm2')"][b % 4]
            then = [{"kind": "weight", "param": f"k{k}", "value": f"v{b % 8}", "factor": 3}, {"kind": "range", "param": f"k{k}", "min": 10}, {"kind": "weight", "param": f"k{k}", "value": "true", "factor": 2}, {"kind": "weight", "param": f"k{k}", "value": f"m{b % 6}", "factor": 2}][kind]
            soft.append({"name": f"s{k}_{b}", "when": when, "then": [then]})
        if kind == 1 and k > 8:
            hard.append({"name": f"h{k}", "expr": f"k{k} <= 45 or k{k - 8} <= 45"})
    d = dictionary.loads(json.dumps({"params": params, "soft": soft, "hard": hard}))
    assert len(d.soft) > 100 and len(d.hard) > 10
    rows = sampling.population(spark, d, 120, 5)
    assert rows.count() == 120 == rows.select("k0").distinct().count()
    assert rows.where(rules.first_violated([(h["name"], h["expr"]) for h in d.hard], d.kinds()).isNotNull()).isEmpty()
    assert rows.where("k2 and k5 < 0 or k9 < 10 and k5 > 25").isEmpty()


def test_reshoot_and_preview(spark):
    d = dictionary.loads(json.dumps(TOY))
    rows = sampling.population(spark, d, 30, 1).drop("attempt")
    new = {r["idx"]: r for r in sampling.reshot(rows, d, ["town"], 99).collect()}
    old = {r["idx"]: r for r in rows.collect()}
    assert all(new[i]["age"] == old[i]["age"] and new[i]["years"] == old[i]["years"] for i in old) and any(new[i]["town"] != old[i]["town"] for i in old)
    assert set(api.preview(spark, d, 20)) == {"age", "town", "years"}
    with pytest.raises(ValueError):
        api.plan(spark, d, 5, "s", "k", cohorts=[{"name": "c", "share": 2.0}])


# ---- texts and sources


def test_unique_against_a_base(spark):
    texts = {1: "a b c d e f g h", 2: "q r s t u v w x", 3: "q r s t u v w z", 4: "one two three four"}
    s = similarity.sets(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    base = similarity.sets(spark.createDataFrame([("k", "a b c d e f g y")], "doc_id string, text string"))
    assert {r["id"]: r["accepted"] for r in similarity.unique(s, 0.4, base).collect()} == {1: False, 2: True, 3: False, 4: True}


def test_running_sums(spark):
    r = random.Random(3)
    values = r.sample(range(10_000), 500)
    df = spark.createDataFrame([(v, v % 5) for v in values], "x long, c long")
    got = {x["x"]: x["upto"] for x in ranks.running(df, [F.col("x").asc()], F.col("c")).collect()}
    total, want = 0, {}
    for v in sorted(values):
        total += v % 5
        want[v] = total
    assert got == want
    rows = [(0 if i % 10 else i % 70 or None, i, i % 3) for i in range(900)]  # one group has most rows
    sums = {}
    want = {}
    for g, i, c in rows:
        want[i] = sums[g] = sums.get(g, 0) + c
    hot = spark.createDataFrame(r.sample(rows, len(rows)), "g long, i long, c long")
    assert {x["i"]: x["upto"] for x in ranks.running(hot, [F.col("i").asc()], F.col("c"), by=["g"]).collect()} == want


def test_wrapped_lines(spark):
    row = spark.createDataFrame([("the quick  brown fox",), ("",)], "x string").select(T.wrapped(F.col("x"), 10).alias("w")).collect()
    assert [r["w"] for r in row] == [["the quick", "brown fox"], []]


def test_sources(spark, tmp_path):
    with pytest.raises(LookupError, match="m2"):
        records.prices(spark.createDataFrame([("m1", 1.0)], "model string, price double"), spark.createDataFrame([("m1",), ("m2",)], "model string"))
    with pytest.raises(ValueError):
        records.page(spark.range(3), "")
    with pytest.raises(ValueError):
        records.where_equal(spark.range(3), {"page": 1})
    book = {"male_first": [{"name": "Bare", "by_decade": {"1990": 1}, "weight": 1}], "female_first": [], "patronymics": {}, "surnames": []}
    (tmp_path / "book.json").write_text(json.dumps(book))
    with pytest.raises(ValueError, match="Bare"):
        records.name_book(spark, str(tmp_path / "book.json"))
    images = records.decoded_images(spark.createDataFrame([("a/b", "/9j/4AA="), ("c", "iVBORw0K")], "key string, data64 string"), "data64")
    records.write_images(images, str(tmp_path / "images"))
    assert {(r["file"], r["type"]) for r in spark.read.parquet(str(tmp_path / "images")).collect()} == {("a_b.jpg", "jpg"), ("c.png", "png")}
    assert records.unverified(spark.createDataFrame([("m", True), ("n", False)], "model string, verified boolean")).first()[0] == "n"
    records.create_collection(spark, "made_here", "a long")
    records.create_collection(spark, "made_here", "a long")
    assert spark.table("made_here").columns == ["a", "natural_key", "batch_id"]
    spark.sql("DROP TABLE made_here")
