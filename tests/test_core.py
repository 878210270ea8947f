import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from muster.functions import rules
from muster.functions import text as T
from muster.operators import media, queue, sampling, similarity
from muster.plans import dictionary


@pytest.mark.parametrize(("source", "want"), [("not (nothing + 1 > 2)", False), ("not (nothing > 2)", True), ("nothing == null", True), ("1 / 0 > 0 or true", False), ("true or 1 / 0 > 0", True), ("age - 2 * 3 = 4", True), ("has(skills, 'plan')", True), ("in(age, 10, '11')", True), ("not age == 10", False), ("-age < 0 and name", False)])
def test_rules(spark, source, want):
    row = spark.createDataFrame([(10, "", ["plan"])], "age long, name string, skills array<string>")
    assert row.select(rules.holds(source, rules.kinds_of(row))).first()[0] is want
    assert str(rules.parse(str(rules.parse(source)))) == str(rules.parse(source))


@pytest.mark.parametrize("source", ["", "a ==", "(a", "a b", "has(a)", "'x", "a ~ b", "a < b < c"])
def test_rules_that_do_not_parse(source):
    with pytest.raises(rules.RuleError):
        rules.parse(source)


def test_allocation():
    for n in (0, 1, 7, 33, 100, 999):
        assert sum(sampling.allocate(n, [0.33, 0.33, 0.34])) == n
    assert sampling.allocate(10, [0, 0]) == [5, 5]
    assert sampling.allocate(10, [1, 1, 1]) == [4, 3, 3]


def test_dictionary_checks():
    p = lambda k, **x: {"key": k, "domain": x}
    bad = dictionary.Dictionary([p("a", type="int", min=2, max=1), p("a", type="enum", variants=[]), p("c", type="computed", expr="z + 1")], [{"name": "h", "expr": "zz > 1"}], [{"name": "s", "when": "c > 1", "then": [{"key": "a", "type": "range", "min": 1}]}])
    said = " ".join(dictionary.issues(bad))
    for part in ("declared twice", "min over max", "no variants", "z is not declared", "no parameter zz", "not declared before a", "identity"):
        assert part in said
    with pytest.raises(dictionary.DictionaryError):
        dictionary.loads('{"extends": ["x"], "params": []}')


def test_population(spark):
    from muster.catalog import _COHORTS, _DICTIONARY

    got = sampling.population(spark, dictionary.loads(_DICTIONARY), 40, 3, _COHORTS).collect()
    assert len(got) == 40 and sum(r["cohort"] == "young" for r in got) == 12
    assert all(r["years"] <= r["age"] - 20 and r["start"] == 2026 - r["years"] and 1 <= len(r["skills"]) <= 3 for r in got)
    assert all(r["age"] <= 35 for r in got if r["cohort"] == "young")
    assert len({(r["age"], r["region"], r["years"], tuple(r["skills"])) for r in got}) == 40


def test_first_come_is_not_drop_all(spark):
    ids = spark.createDataFrame([(i,) for i in range(4)], "id long")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "a long, b long")
    assert {r["id"]: r["accepted"] for r in similarity.first_come(ids, edges).collect()} == {0: True, 1: False, 2: True, 3: False}


def test_unique_with_copies(spark, tmp_path):
    from muster.catalog import queries

    texts = {1: "a b c d e f g h", 2: "a b c d e f g x", 3: "a b c d e f g x", 4: "A b c d e f g h", 5: "q r s t u", 6: "q r s t u", 7: "", 8: "", 9: None, 10: "c d e f g x y z w"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    sets = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, x in texts.items() for w in [(x or "").lower().split()]}
    stand: list[int] = []
    for i, s in sets.items():
        if not any(s & sets[j] and len(s & sets[j]) > 0.5 * len(s | sets[j]) for j in stand):
            stand.append(i)
    got = {r["id"]: r["accepted"] for r in queries()["txt_unique_greedy"](spark, str(tmp_path)).collect()}
    assert stand == [1, 5, 7, 8, 9, 10] and got == {i: i in stand for i in texts}


def test_offers_of_all_parts(spark, tmp_path):
    from muster.catalog import queries

    suppliers = [(i, i % 7, 100.0 if i % 2 else -5.0) for i in range(1, 12)]
    parts = [(i, i % 50 + 1, 900.0 + i) for i in range(1, 121)]
    for name, rows, ddl in (("supplier", suppliers, "s_suppkey long, s_nationkey int, s_acctbal double"), ("part", parts, "p_partkey long, p_size int, p_retailprice double"), ("nation", [(i, i % 5) for i in range(25)], "n_nationkey int, n_regionkey int")):
        spark.createDataFrame(rows, ddl).write.parquet(str(tmp_path / f"{name}.parquet"))
    want = {}
    for place, nation, balance in suppliers:
        for service, size, retail in parts:
            if nation % 5 == size % 5 and (size % 3 == 1 or (size % 3 == 0 and balance > 0)):
                draw = int(hashlib.md5(f"2026|{place}:{service}".encode()).hexdigest()[:8], 16) % 1000 / 1000
                x = (retail * 10 + math.floor((retail * 30 - retail * 10) * draw)) * (1 + nation / 10 if nation % 5 < 3 else 1.0)
                step = 5000 if x >= 50000 else 1000 if x >= 10000 else 100
                want[place, service] = math.floor(x / step + 0.5) * step
    got = {(r["place"], r["service"]): r["price"] for r in queries()["cmp_offers"](spark, str(tmp_path)).collect()}
    assert got == want and len({s for _, s in want}) > 60


def test_claims(spark):
    df = spark.createDataFrame([("в пять лет и twenty three long years, in 1999 years 7 7",), ("",)], "t string").select(F.split(F.lower("t"), T.SPLIT).alias("w"))
    got = [r[0] for r in df.select(T.year_claims(F.col("w"))).collect()]
    assert [(c["n"], c["at_age"]) for c in got[0]] == [(5, True), (23, False)] and got[1] == []


def test_fold(spark):
    events = spark.createDataFrame([(1, 1, "claim", 0.0), (1, 2, "fail", 0.5), (1, 3, "claim", 0.0), (1, 4, "complete", 0.5), (2, 5, "claim", 0.0), (2, 6, "release", 0.0), (3, 7, "claim", 0.0)], "job long, id long, event string, cost double")
    assert {r["job"]: (r["status"], r["attempts"], r["cost"]) for r in queue.fold(events).collect()} == {1: ("done", 2, 1.0), 2: ("pending", 0, 0.0), 3: ("running", 1, 0.0)}


def test_images():
    image = np.random.default_rng(1).integers(0, 255, (50, 60, 3)).astype(np.uint8)
    a, b = media.finished(image, "k", 1), media.finished(image, "k", 1)
    assert (a == b).all() and abs(a.shape[1] / a.shape[0] - 0.8) < 0.05
