"""Links between sets: brute force, and how much is moved for them."""

import random

from muster.operators import similarity


def clusters(n=240, seed=11):
    """Sets with near copies, copies, a shingle of half of all sets, and sizes from 1 up."""
    r, out = random.Random(seed), {}
    for i in range(n):
        old = out[r.randrange(i)] if i and r.random() < 0.7 else None
        some = set(r.sample(range(10**6), r.randrange(1, 40))) if old is None else {g for g in old if r.random() < r.choice([0.6, 0.9, 1.0])} | set(r.sample(range(10**6), r.randrange(0, 6)))
        out[i] = (some | {7} if i % 2 else some) or {i}
    out[n], out[n + 1] = set(), set(out[3])
    return out


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def frame(spark, sets, kind="long"):
    return spark.createDataFrame([(i if kind == "long" else f"t{i:04}", sorted(s)) for i, s in sets.items()], f"id {kind}, s array<long>")


def moved(spark):
    """Bytes shuffled and written by stages so far."""
    store = spark._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() + stages.apply(i).outputBytes() for i in range(stages.size()))


def check(spark, t, kind):
    sets = clusters()
    least = {}
    for i, s in sorted(sets.items()):
        if s:
            least.setdefault(frozenset(s), []).append(i)
    heads = {v[0]: k for k, v in least.items()}
    want = sorted((a, b, round(jaccard(heads[a], heads[b]), 5), len(least[heads[a]]), len(least[heads[b]])) for a in heads for b in heads if a < b and jaccard(heads[a], heads[b]) > t + 1e-9)
    given = frame(spark, sets, kind)
    number = int if kind == "long" else (lambda x: int(x[1:]))
    got = sorted((number(r["a"]), number(r["b"]), round(r["score"], 5), r["copies_a"], r["copies_b"]) for r in similarity.near_pairs(given, t).collect())
    assert got == want and len(want) > 20
    base, new = {i: s for i, s in sets.items() if i % 2}, {i: s for i, s in sets.items() if i % 2 == 0}
    best = {i: min((-round(jaccard(s, o), 5), j) for j, o in base.items()) for i, s in new.items() if any(jaccard(s, o) > t + 1e-9 for o in base.values())}
    close = similarity.too_close(frame(spark, new), frame(spark, base, kind), t).collect()
    assert {r["id"]: (-round(r["score"], 5), number(r["other"])) for r in close} == best
    stand: list[int] = []
    for i, s in sorted(sets.items()):
        if not any(jaccard(s, sets[j]) > t + 1e-9 for j in stand):
            stand.append(i)
    assert {number(r["id"]) for r in similarity.unique(given, t).where("accepted").collect()} == set(stand)


def test_links_are_brute_force(spark):
    check(spark, 0.5, "long")


def test_links_in_small_parts_and_by_texts(spark, monkeypatch):
    for name, value in (("CELLS", 60), ("HOME", 3), ("GROUP", 5), ("KNOWN", 4)):
        monkeypatch.setattr(similarity, name, value)
    check(spark, 0.3, "string")


def test_sets_are_hardly_moved_for_links(spark):
    """half of a set's shingles go out once, and whole sets only where they are in a pair. They were moved and written some eight times."""
    r = random.Random(5)
    sets = {i: set(r.sample(range(1 << 60), 500)) for i in range(400)} | {1000 + i: set(r.sample(range(1 << 60), 50)) for i in range(20)}
    given = frame(spark, sets)
    given.write.parquet(path := similarity.cut.__globals__["folder"](spark, "given"))
    given = spark.read.parquet(path)
    before = moved(spark)
    assert similarity.near_pairs(given, 0.5).count() == 0
    assert moved(spark) - before < 3 * 8 * sum(map(len, sets.values()))


def test_a_stream_writes_each_set_once(spark):
    """an index of postings, written again with each merge, held the accepted sets more than four times over."""
    from muster.operators.lineage import folder
    from muster.streaming import unique

    r, path, size = random.Random(6), folder(spark, "stream"), 0
    before = moved(spark)
    for k in range(4):
        rows = [(100 * k + i, " ".join(f"w{r.randrange(10**6)}" for _ in range(300))) for i in range(60)]
        size += 8 * 298 * len(rows)
        unique.judge(spark.createDataFrame(rows, "id long, text string"), k, path, 0.5)
    assert unique.accepted(spark, path).where("accepted").count() == 240
    assert moved(spark) - before < 8 * size


def texts_below(spark, parts=8):
    """Texts of words of their own in several files, and how large their sets are."""
    from muster.operators.lineage import folder

    r = random.Random(8)
    rows = [(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(302))) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(parts).write.parquet(f"{(path := folder(spark, 'texts'))}/documents.parquet")
    return path, 8 * 300 * len(rows)


def test_pairs_move_less_than_their_sets(spark):
    """texts and first shingles were shuffled in rows of some twenty bytes and all sets were written, which is several times what the sets are."""
    from muster import catalog

    path, size = texts_below(spark)
    before = moved(spark)
    assert catalog.txt_near_dup_pairs(spark, path).count() == 0
    assert moved(spark) - before < size


def test_shingles_that_are_one_in_few_bits(spark, monkeypatch):
    """shingles go out by bucket and 32 bits; where those of a set coincide, and those of others with them, no pair is lost and none is made."""
    monkeypatch.setattr(similarity, "BUCKETS", (1, 1))
    low = [5 + (i << 32) for i in range(6)]
    sets = {0: {*low, 1, 2}, 1: {*low, 1, 3}, 2: {*low[:3], 10, 11, 12}, 3: {*low[3:], 13, 14, 15}, 4: {low[0], 20}, 5: {low[5], 20}, 6: {low[1]}, 7: {low[2]}}
    want = sorted((a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) > 0.2 + 1e-9)
    assert sorted((r["a"], r["b"]) for r in similarity.near_pairs(frame(spark, sets), 0.2).collect()) == want and len(want) > 4


def test_unique_texts_move_less_than_their_sets(spark):
    """as F9."""
    from muster import catalog

    path, size = texts_below(spark)
    before = moved(spark)
    assert catalog.txt_unique_greedy(spark, path).where("accepted").count() == 400
    assert moved(spark) - before < size
