import random

from pyspark.sql import functions as F

from muster.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, id string, score string"


def brute(rows, anchors, k=5, n=3):
    good = [(i, [int(256 * x // 1) for x in v], b) for i, v, b, *_ in rows if b is not None and v is not None and all(x is not None and abs(x) < 1e30 for x in v)]
    out = []
    order = lambda s: (-s[1], s[0] is None, s[0] or 0)
    for a, (i, v, b) in enumerate(good):
        if i is None or not anchors(i):
            continue
        scores = [(j, sum(x * y for x, y in zip(v, w, strict=False)), c) for o, (j, w, c) in enumerate(good) if o != a]
        for j, s, _ in sorted([x for x in scores if x[2] == b], key=order)[:k]:
            bad = sorted([x for x in scores if x[2] != b and 50 * s <= 100 * x[1] <= 95 * s], key=order)[:n]
            out += [(i, j, r, x[0], s, x[1]) for r, x in enumerate(bad, 1)]
    return sorted(out, key=repr)


def rows_of(seed, n, spread):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(8)] for _ in range(4)]
    out = []
    for i in range(n):
        c = r.choice(centres)
        out.append((i, [float(round((x + r.gauss(0, spread)) * 64)) / 64 for x in c], r.randrange(3), "x", None))
    return out


def test_hard_negatives_are_those_of_brute_force(spark, monkeypatch):
    rows = rows_of(1, 400, 0.4) + [(500 + i, [1.0] * 8, i % 3, "hot", "") for i in range(150)]  # a third is one vector
    rows += [rows[0], rows[0], rows[10], (0, [0.5] * 8, 1, "", ""), (None, [1.0] * 8, 2, None, None), (None, [0.9] * 8, 1, None, None)]
    rows += [(600, None, 1, "", ""), (610, [1.0] * 8, None, "", ""), (620, [1.0, None], 1, "", ""), (630, [float("nan")] * 8, 1, "", ""), (640, [float("inf")], 1, "", ""), (650, [], 1, "", ""), (660, [1.5, 2.0], 0, "", ""), (670, [1e6] * 3, 0, "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(negatives, "BLOCK", 64)
    monkeypatch.setattr(negatives, "PART", 8)
    got = negatives.hard_negatives(docs, lambda i: i % 10 == 0)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, lambda i: i % 10 == 0)
    assert negatives.hard_negatives(docs.where("false"), lambda i: i % 10 == 0).count() == 0


def test_bounds_keep_rows_from_groups_they_cannot_serve(spark, monkeypatch):
    """Far apart clusters: a group gets fewer rows than there are, and the result stays whole."""
    rows = [(i, [float(40 * (i % 4 == c)) + random.Random(i * 9 + c).random() for c in range(4)], i // 4 % 2, "", "") for i in range(400)]
    made, real = [], negatives._tasks

    def spy(anchors, given, needed, *rest):
        made.append((needed.agg(F.sum("rows")).first()[0], needed.select("group").distinct().count()))
        return real(anchors, given, needed, *rest)

    monkeypatch.setattr(negatives, "_tasks", spy)
    monkeypatch.setattr(negatives, "PIVOTS", 32)
    got = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), lambda i: i % 10 == 0)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, lambda i: i % 10 == 0)
    assert all(sent < 0.8 * len(rows) * groups for sent, groups in made)


def test_large_components_stay_exact(spark):
    r = random.Random(3)
    rows = [(i, [float(r.randrange(-(2**17), 2**17)) for _ in range(3)], i % 2, "", "") for i in range(60)]
    got = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), lambda i: i % 5 == 0)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, lambda i: i % 5 == 0)
