"""Extra columns that clash, ties and whole texts, for operators whose other tests have none of them."""

import random

from muster.llm import decontam, spm, suffix_dedup
from muster.llm.queries import vocabulary


def test_repeats_with_clashing_columns(spark):
    r = random.Random(1)
    passage = bytes(r.randrange(97, 123) for _ in range(150)).decode()
    rows = [(1, "a" + passage, 7, "kind", None), (2, passage + "b", 7, "kind", b"x"), (None, None, None, None, None), (3, "", 1, "", b"")]
    plain = suffix_dedup.remove_repeats(spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string"))
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, cell int, kind string, blob binary"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    assert {x["doc_id"]: x["n_removed"] for x in got.collect()} == {1: 0, 2: 150, None: 0, 3: 0}


def test_pieces_with_clashing_columns(spark):
    path = vocabulary("piece_bpe_32k.model")
    rows = [(1, "Some words.", "x", 1), (None, None, None, None), (2, "", "", 0), (2, "Some words.", "y", 2), (3, "w" * 100_000, "", 3)]
    got = spm.digest(spark.createDataFrame(rows, "doc_id long, text string, ids string, n_pieces int"), path).collect()
    plain = spm.digest(spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string"), path).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, plain), key=str) and len(got) == len(rows)
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    counts = sorted((x["doc_id"] is None, x["doc_id"] or 0, x["n_pieces"]) for x in got)
    assert counts == sorted((i is None, i or 0, len(library.encode(t or ""))) for i, t, *_ in rows)


def test_leaks_at_two_places_of_equal_edits(spark):
    """The first of the best places is told, with all extra columns of docs and benchmark left aside."""
    r = random.Random(4)
    item = " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(12))
    near = item[:40] + "z" + item[41:]
    text = f"{near} between {near} and {near}"
    docs = spark.createDataFrame([(1, text, 5, "s"), (2, f"x {item} y {near}", 6, "e")], "doc_id long, text string, item_id int, start string")
    got = {x["doc_id"]: (x["edits"], x["start"], x["end"]) for x in decontam.contaminated(docs, spark.createDataFrame([(9, item, "n")], "item_id long, text string, doc_id string")).collect()}
    assert got[1] == (1, 0, len(item)) and got[2] == (0, 2, 2 + len(item))
