import random

from muster.llm import decontam, ngram_join

SCHEMA = "doc_id long, text string, own string, class string, _id long"


def variant(seed, changed=False, words=60):
    r = random.Random(seed)
    w = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(words)]
    return " ".join([*w[:-1], "changed"] if changed else w)


def test_near_copies_go_by_row(spark):
    a, a2, b, b2 = variant(1), variant(1, True), variant(2), variant(2, True)
    got = ngram_join.drop_near_copies(spark.createDataFrame([(1, a, "x", "", 1), (3, a2, "y", "", 2), (3, b, "z", "", 3), (7, b2, None, None, 4)], SCHEMA))
    assert sorted(map(tuple, got.collect())) == [(1, a, "x", "", 1), (3, b, "z", "", 3)]


def test_near_copies_of_odd_ids(spark):
    c, c2, d = variant(3), variant(3, True), variant(4)
    rows = [(None, c, "", "", 1), (None, c2, "", "", 2), (None, c, "", "", 3), (5, d, "", "", 4), (5, d, "", "", 4), (5, d, "later", "", 5), (None, None, "", "", 6), (None, None, "", "", 6), (5, "", "", "", 7), (2, c2, "", "", 8), (None, variant(5), "", "", 9)]
    got = sorted(map(tuple, ngram_join.drop_near_copies(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    assert len(got) == 6 and [r[:2] for r in got if r[1] in (c, c2)] == [(2, c2)]  # one of each class, and all rows without words
    assert [r[:2] for r in got if r[1] == d] == [(5, d)] and sum(not r[1] for r in got) == 3
    assert ngram_join.drop_near_copies(spark.createDataFrame([], SCHEMA)).count() == 0


def test_contaminated_rows_go_by_row(spark):
    item = variant(9, words=20)
    held = variant(10) + " " + item + " " + variant(11)
    rows = [(None, held, "", "", 1), (None, variant(12), "", "", 2), (None, None, "", "", 3), (5, held, "", "", 4), (5, variant(13), "", "", 5)]
    df, items = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(map(tuple, decontam.drop_contaminated(df, items).collect()), key=repr) == sorted((rows[k] for k in (1, 2, 4)), key=repr)
    assert decontam.drop_contaminated(df, items.where("false")).count() == 5
    assert decontam.drop_contaminated(df.where("false"), items).count() == 0
