import hashlib
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from muster.llm import decontam, exact_dedup, license, ngram_join, pii, quality, sharding, simple8b, spm, suffix_dedup
from muster.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, low string"
ROWS = [(1, "Some text. " * 30, "x"), (2, "some TEXT. " * 30, None), (2, None, "y"), (None, "", "z"), (None, None, "z"), (5, "é" * 400 + " a", "z"), (5, "é" * 400 + " a", "z"), (7, "w" * 70000, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_odd_rows_and_empty_tables(spark, odd):
    empty, items = odd.where("false"), spark.createDataFrame([(1, "x"), (2, None)], "item_id long, text string")
    tokens = vocabulary("word_bpe_49k.json")
    for f in (exact_dedup.exact_groups, license.scan, sharding.assign, suffix_dedup.remove_repeats, ngram_join.jaccard_join, lambda d: pii.replace_entities(d, "k"), lambda d: simple8b.round_trip(d, tokens), lambda d: spm.digest(d, vocabulary("piece_bpe_32k.model")), lambda d: quality.score(d, quality.fit(np.zeros((0, len(quality.FEATURES))), np.zeros(0)))):
        assert f(odd).count() == len(ROWS)
        assert f(empty).count() == 0
    assert decontam.contaminated(odd, items).count() == 0


def test_fingerprints_compose():
    b = random.Random(1).randbytes(200_000)
    assert exact_dedup.combine(exact_dedup.fingerprint(b[:777]), exact_dedup.fingerprint(b[777:])) == exact_dedup.fingerprint(b)


def test_exact_groups(odd):
    got = {(r["doc_id"], r["text_sha256"]): (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_groups(odd).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1, sha("some text. " * 30)] == (2, 2)
    assert got[None, sha("")] == (2, 3)
    assert exact_dedup.drop_copies(odd).count() == 4


def test_simple8b_round_trip():
    r = np.random.default_rng(1)
    for k in range(40):
        n = int(r.integers(0, 800))
        ids = r.integers(0, 1 << int(r.integers(1, 62)), n).astype(np.uint64)
        if k % 3 == 0 and n:
            ids[:: max(1, n // 9)] = 2**64 - 1
        bounds = np.sort(np.concatenate(([0, n], r.integers(0, n + 1, 4))))
        words, _, escapes = simple8b.encode(ids, bounds)
        assert (simple8b.decode(words, escapes) == ids).all()


def test_documents_decode_by_themselves():
    r = np.random.default_rng(5)
    for _ in range(20):
        n = int(r.integers(1, 400))
        ids = r.integers(0, 1 << 40, n).astype(np.uint64)
        ids[r.random(n) < 0.1] = 2**63 + 5  # escapes, before and in each document
        ids[r.random(n) < 0.02] = 2**60 - 1
        bounds = np.sort(np.concatenate(([0, n], r.integers(0, n + 1, 6))))
        words, offsets, escapes = simple8b.encode(ids, bounds)
        places = simple8b.escape_offsets(ids, bounds)
        for k in range(len(bounds) - 1):
            assert (simple8b.decode_document(words, escapes, offsets, places, k) == ids[bounds[k] : bounds[k + 1]]).all()


def test_some_documents_of_a_table(spark, tmp_path):
    texts = [(i, f"some words {i} and more" * (i % 7)) for i in range(200)] + [(5, "again"), (None, "none"), (300, None)]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in texts], "doc_id long, text string, words string, shard string")
    path = vocabulary("word_bpe_49k.json")
    simple8b.write_tokens(docs, path, 2, str(tmp_path / "t"))
    got = simple8b.read_documents(spark, str(tmp_path / "t"), spark.createDataFrame([(5,), (17,), (300,), (999,), (None,), (5,)], "doc_id long")).collect()
    t = simple8b.Tokenizer(path)

    def ids(text):
        return t.encode(pa.array([text]))[0].tolist() + [2]

    assert sorted((r["doc_id"], list(r["ids"])) for r in got) == sorted([(5, ids(dict(texts[:200])[5])), (5, ids("again")), (17, ids(texts[17][1])), (300, [2])])


def test_tokenizer_is_the_library():
    t = simple8b.Tokenizer(vocabulary("word_bpe_49k.json"))
    texts = ["eren*** x|y ab|| it's a<| b_c éa!! A-B `", "don't <|endoftext|>x a,b. c!, d., 123, é., ÿŸ ß. . , .", "", None, "a" * 3000, "ſ K Å ﬁ. ª º µ."]
    ids, bounds = t.encode(pa.array(texts))
    for i, text in enumerate(texts):
        assert t.library.encode(text or "", add_special_tokens=False).ids == ids[bounds[i] : bounds[i + 1]].tolist()


def _merged(pieces, text):
    """Pieces of a text by merging the neighbours of best rank, the leftmost of equal ones, until none merge."""
    parts = list(text)
    while True:
        found = [(pieces[x + y], k) for k, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in pieces]
        if not found:
            return parts
        k = min(found)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def test_pieces_are_those_of_the_merges():
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    c, library = spm.coder(path), sentencepiece.SentencePieceProcessor(model_file=path)
    ranks = {library.id_to_piece(k): -library.get_score(k) for k in range(library.get_piece_size()) if not (library.is_byte(k) or library.is_control(k) or library.is_unknown(k))}
    r = random.Random(1)
    texts = ["".join(r.choice("abthe  é漢.\n😀ー01") for _ in range(r.randint(1, 40))) for _ in range(400)]
    texts += [" " * k + w + " " * j for k in range(20) for w in ("a", "漢", "the x") for j in (0, 1, 3)] + ["", None, "a" * 9000, "漢字" * 5000, "the" * 4000, " " * 3000 + "x", "▁"]
    ids, bounds = c.encode(pa.array(texts))
    back, at = c.decode(ids, bounds)
    for k, text in enumerate(texts):
        own = ids[bounds[k] : bounds[k + 1]].tolist()
        assert own == library.encode(text or ""), text
        raw = (text or "").replace("▁", " ")
        assert back[at[k] : at[k + 1]].tobytes() == ((" " + raw).encode() if raw else b"")
        if text and len(text) < 50:
            plain = []
            for piece in _merged(ranks, "▁" + raw.replace(" ", "▁")):
                plain += [library.piece_to_id(piece)] if piece in ranks else [int(c.byte[b]) for b in piece.encode()]
            assert own == plain


def test_suffix_array_and_repeats(spark):
    r = random.Random(3)
    for k in range(40):
        x = np.array([r.choice([0, 97, 98, 255][: r.randint(1, 4)]) for _ in range(r.randint(1, 300))], np.uint8)
        order = [x.tobytes()[i : i + 100] for i in suffix_dedup.suffix_array(x).tolist()]
        assert order == sorted(order) and len(order) == len(x)
    rows = [(i, "".join(r.choice("ab") for _ in range(3)) * r.randint(0, 100) + "é" * r.randint(0, 120)) for i in range(30)]
    seen, want = set(), {}
    for i, t in rows:
        b, gone = t.encode(), np.zeros(len(t.encode()), bool)
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = True
            seen.add(b[k : k + 100])
        want[i] = (len(b), int(gone.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["kept_sha256"]) for x in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_repeats_of_equal_rows(spark):
    a, b = "".join(chr(97 + i * i % 23) + str(i) for i in range(120)), "".join(chr(98 + i * 7 % 19) + str(i * 3) for i in range(90))
    rows = [(None, a), (None, a), (1, a + b), (1, a + b), (1, a + b), (2, b), (3, "x" * 150), (3, "x" * 150), (None, "short")]
    seen, want = set(), {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0], hashlib.sha256(r[1].encode()).hexdigest())):
        raw, gone = t.encode(), np.zeros(len(t), bool)
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in seen:
                gone[k : k + 100] = True
            seen.add(raw[k : k + 100])
        want[i, t] = (i, len(raw), int(gone.sum()), hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
    got = [(x["doc_id"], x["n_bytes"], x["n_removed"], x["kept_sha256"]) for x in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted((want[r] for r in rows), key=str)


@pytest.mark.parametrize("most", [4, 1024])
def test_repeats_of_a_common_passage(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "HOT_RUNS", most)
    r = random.Random(8)
    prose = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    passage, tails = prose(400), [prose(40) for _ in range(5)]
    rows = [(i, prose(r.randint(0, 150)) + r.choice(tails) * (i % 3) + passage[: 400 - i % 7] + r.choice(tails)[: r.randint(0, 40)] + prose(r.randint(0, 90))) for i in range(5000)]
    rows[17] = (17, rows[17][1] + passage + prose(3_000_000) + passage + rows[3][1])  # over several slabs
    seen, want = set(), {}
    for i, t in rows:
        raw, gone = t.encode(), np.zeros(len(t) + 1, np.int64)
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in seen:
                gone[k] += 1
                gone[k + 100] -= 1
            seen.add(raw[k : k + 100])
        gone = np.cumsum(gone)[:-1] > 0
        want[i] = (len(raw), int(gone.sum()), hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["kept_sha256"]) for x in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    assert got == want


def test_links_are_those_of_brute_force(spark):
    r = random.Random(5)
    words = ["w%d" % i for i in range(400)]
    base = [[r.choice(words) for _ in range(80)] for _ in range(6)]
    rows = []
    for i in range(60):
        w = list(base[i % 6])
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((i, " ".join(w)))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    want = {i: sum(len(s & o) >= 0.8 * len(s | o) for j, o in sets.items() if j != i) for i, s in sets.items()}
    got = {x["doc_id"]: x["n_links"] for x in ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_links_of_buckets_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    words = ["w%d" % i for i in range(600)]
    texts = [words[8 * i : 8 * i + 160] for i in range(24)] + [[*words[300:459], "x"][: 10 + 6 * i] + ["y%d" % i] + words[311 + 6 * i : 460] for i in range(24)]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in enumerate(texts)}
    want = {i: sum(len(s & o) >= 0.8 * len(s | o) for j, o in sets.items() if j != i) for i, s in sets.items()}
    assert min(want.values()) > 1
    got = {x["doc_id"]: x["n_links"] for x in ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_links_of_a_template(spark):
    words = ["w%d" % i for i in range(60)]
    rows = [(i, " ".join([*words, *(f"v{i}x{k}" for k in range(5))])) for i in range(3500)] + [(9000 + i, " ".join(f"u{i}x{k}" for k in range(30))) for i in range(300)]
    got = {x["doc_id"]: (x["class_id"], x["class_size"], x["n_links"]) for x in ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (0, 3500, 3499) if i < 3500 else (i, 1, 0) for i, _ in rows}


def test_links_of_odd_rows(spark):
    a, b = " ".join("w%d" % i for i in range(40)), " ".join("w%d" % i for i in range(39)) + " other"
    rows = [(None, a, 1), (None, a, 1), (None, b, 1), (3, a.upper(), 2), (3, a, 2), (7, b, 3), (8, "", 3), (8, None, 3), (9, "few words", 3), (10, "Few, words!", 3), (11, "?!", 3)]
    got = sorted([tuple(x) for x in ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string, key int")).collect()], key=str)
    assert got == sorted([(None, 3, 6, 5)] * 3 + [(3, 3, 6, 5)] * 2 + [(7, 3, 6, 5), (8, 8, 1, 0), (8, 8, 1, 0), (9, 9, 2, 1), (10, 9, 2, 1), (11, 11, 1, 0)], key=str)
    left = ngram_join.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string, key int"))
    assert left.columns == ["doc_id", "text", "key"] and sorted(str(r["doc_id"]) for r in left.collect()) == sorted(["3", "8", "8", "9", "11"])  # one row of each class, however its ids repeat


def _least_edits(item, text):
    """Least edits of an item against any stretch of a text."""
    row, d = np.zeros(len(text) + 1, np.int64), np.arange(len(text) + 1)
    codes = np.array(list(text)) if text else np.zeros(0, "<U1")
    for k, c in enumerate(item):
        row = np.minimum.accumulate(np.append(k + 1, np.minimum(row[1:] + 1, row[:-1] + (codes != c))) - d) + d
    return int(row.min())


def test_leaks_are_those_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 300)  # several blocks of items
    r = random.Random(6)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(30)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = {k: prose(r.randint(4, 14)) for k in range(12)} | {20: prose(3) + " " + "the same template of many items " + prose(2), 21: "the same template of many items " + prose(4)}
    texts = {}
    for i in range(60):
        w = items[r.choice(list(items))]
        for _ in range(r.randint(0, 6)):
            at = r.randrange(len(w))
            w = w[:at] + r.choice(["", "x", "yz"]) + w[at + r.randint(0, 1) :]
        texts[i] = prose(r.randint(0, 12)) + " " + w + " " + prose(r.randint(0, 12))
    texts |= {60: None, 61: "", 62: " ".join(items.values()) * 40}
    plain = lambda t: re.sub("[^a-z]+", " ", (t or "").lower())
    want = {}
    for i, t in texts.items():
        for k, item in items.items():
            x, most = plain(item).strip(), 0
            most = min(int(0.1 * len(x)), (len(x) - 8) // 8)
            if (e := _least_edits(x, plain(t))) <= most:
                want[i, k] = e
    docs, bench = spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x["edits"] for x in decontam.contaminated(docs, bench).collect()}
    assert got == want and len(want) > 30


def test_leaks(spark):
    r = random.Random(2)
    item = "".join(r.choice("abcdefghijklmnop ") for _ in range(120))
    near = item[:50] + "z" + item[51:90] + item[92:]
    docs = spark.createDataFrame([(1, "before " + item.upper() + " after"), (2, "x" * 50 + " " + near + " y"), (3, item[:60]), (4, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    got = {x["doc_id"]: x["edits"] for x in decontam.contaminated(docs, bench).collect()}
    assert set(got) == {1, 2} and got[1] == 0
    assert [x["doc_id"] for x in decontam.drop_contaminated(docs, bench).orderBy("doc_id").collect()] == [3, 4]


def test_leaks_of_short_items(spark):
    items = {1: "Why?", 2: "Who is he", 3: "Name the capital of Peru", 4: "Which river runs through Cairo today?", 5: "zu", 6: "--"}
    texts = {1: "He asked: why? Whyever", 2: "whys and anywhy", 3: "so, WHO is he!", 4: "name the capitol of peru", 5: "which river runs thrugh Cairo, today", 6: "why", 7: "", 8: None, 9: "name a capitol in peru -- zulu"}
    docs, bench = spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): (x["edits"], x["start"], x["end"]) for x in decontam.contaminated(docs, bench).collect()}
    assert {k: e for k, (e, _, _) in got.items()} == {(1, 1): 0, (3, 2): 0, (4, 3): 1, (5, 4): 1, (6, 1): 0}
    assert got[1, 1][1:] == (10, 13) and got[6, 1][1:] == (0, 3)


def _replaced(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [x["text"] for x in pii.replace_entities(docs, "key").orderBy("doc_id").collect()]


def test_surrogates(spark):
    got = _replaced(spark, ["Mr. John Smith and Mrs Ann Smith, JOHN@x.com john@x.com 4111 1111 1111 1111 10.0.0.1", "Mr John Smith 4111111111111111", None, "", "call 555-0199 or +1 (212) 555-0187"])
    assert got[2] is None and got[3] == "" and "Smith" not in got[0] and "4111" not in got[0] + got[1] and "555" not in got[4]
    assert re.search(r"Mr\. (\w+ \w+) and", got[0])[1] == re.search(r"Mr (\w+ \w+) ", got[1])[1]
    card = re.search(r"\d{16}", got[1])[0]
    assert re.search(r"(\d{4} ){3}\d{4}", got[0])[0].replace(" ", "") == card
    assert sum(int(d) if k % 2 == 0 else int(d) * 2 % 10 + int(d) // 5 for k, d in enumerate(reversed(card))) % 10 == 0
    upper, lower = re.findall(r"\S+@\S+", got[0])
    assert upper.split("@")[0].lower() == lower.split("@")[0] and upper.split("@")[0].isupper() and upper.split("@")[1] == lower.split("@")[1]


def test_one_person_has_one_surrogate(spark):
    a, b, c = _replaced(spark, ["Mr John Smith came. John Smith left. Mr Smith, Dr John Smith. MR SMITH, john? Smith's", "Mrs Ann Smith, Ann.", "Mrs Ελένη Παππά and господин Иванов, John.Doe@X.com\ue000"])
    first, last = re.match(r"Mr (\w+) (\w+) came", a).groups()
    assert a == f"Mr {first} {last} came. {first} {last} left. Mr {last}, Dr {first} {last}. MR {last.upper()}, john? {last}'s"
    assert last not in ("Smith",) and last in b and "Ann" not in b and "Smith" not in a + b
    greek, russian, mail = re.match(r"Mrs (\w+ \w+) and господин (\w+), (\S+)$", c.rstrip("\ue000")).groups()
    assert c.endswith("\ue000") and all(0x370 <= ord(x) < 0x400 for x in greek if x != " ") and all(0x400 <= ord(x) < 0x500 for x in russian)
    assert [x.isupper() for x in mail] == [x.isupper() for x in "John.Doe@X.com"] and mail.endswith(".com")
    assert first.endswith("n") and re.match(r"Mrs (\w+)", b)[1].endswith("na")  # given names end by gender


def test_surrogates_are_distinct(spark):
    r = random.Random(4)
    numbers = [f"{a}-{b:04d}" for a in ("555", "556") for b in range(0, 10000, 3)]  # a third of two formats' hosts
    mails = sorted({f"{''.join(r.choice('abc') for _ in range(3))}@{x}.org" for _ in range(80) for x in "mn"})
    names = [f"{a}{b}{c}" for a in "BCDFGH" for b in "aeiou" for c in ("rt", "nd", "ll")]
    lines = [*numbers, *mails, *(f"Mr {n} Stone" for n in names)]
    got = _replaced(spark, lines)
    assert len(set(got)) == len(lines) and not set(got) & set(lines)
    assert all(re.fullmatch(r"\d{3}-\d{4}", x) for x in got[: len(numbers)]) and len({x.split("@")[1] for x in got[len(numbers) : len(numbers) + len(mails)]}) == 2
    assert len({x.split()[2] for x in got[-len(names) :]}) == 1


def test_nothing_is_left_in_clear(spark):
    texts = {
        "Herr Dr. Müller sprach. Müller ging.": "Müller",
        "Mr J. Smith wrote. Smith J. R. R. Tolkien": "Smith",
        "Prof. Dr. A. B. van Stone, Frau Dr. Änne Groß": "Änne|Groß",
        "call +49 170 1234567 now": "170|1234567",
        "oder 0170/1234567": "1234567",
        "dial 2125550187.": "2125550187",
        "tel +33 (0)1 23 45 67 89": "23 45|45 67",
        "from 2001:0db8:85a3:0000:0000:8a2e:0370:7334 on": "85a3|8a2e|7334",
        "and fe80::1ff:fe23:4567:890a too": "fe23|4567",
        "Mr Li came. Then Li left": "Li",
        "Mr Brown likes brown bread. Brown left.": "Brown",
    }
    got = _replaced(spark, list(texts))
    for (text, gone), new in zip(texts.items(), got, strict=True):
        assert not re.search(rf"(?<!\w)(?:{gone})(?!\w)", new) and new != text, new
    assert re.fullmatch(r"Herr Dr\. (\w+) sprach\. \1 ging\.", got[0]) and re.match(r"Mr [A-Z]\. (\w+) wrote\. \1 ", got[1])
    assert re.fullmatch(r"call \+49 \d{3} \d{7} now", got[3]) and re.fullmatch(r"from (?:[0-9a-f]{4}:){7}[0-9a-f]{4} on", got[7])
    assert re.fullmatch(r"Mr (\w+) came. Then \1 left", got[9]) and re.fullmatch(r"Mr (\w+) likes brown bread\. \1 left\.", got[10])
    plain = ["at 12:30:45 on 2024-01-05, 3.14159265 of 1234567890", "The 12 of 0.1234567890 and a::b", "x 10:20 y", ""]
    assert _replaced(spark, plain) == plain


def test_replacing_by_a_plain_loop(spark):
    """What stands between mentions stays, and each mention becomes what its own replacement says."""
    r = random.Random(6)
    bits = ["Mr Stone", "Mrs Ann Lee", "a@b.org", "10.1.2.3", "4111 1111 1111 1111", "and", "so on,", "Stone", "stone", "it.", "555-0123"]
    texts = ["; ".join(r.choice(bits) for _ in range(r.randrange(1, 30))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, row string, parts string")
    known = {x["mention"]: x["replacement"] for x in pii.surrogates(pii.Scratch(spark, "t"), spark.createDataFrame([(b,) for b in bits if re.search("Mr|[0-9@]", b)] + [("Stone",)], "mention string"), "key").collect()}
    for x in pii.replace_entities(docs, "key").collect():
        text = texts[x["doc_id"]]
        titled = "Mr Stone" in text
        often = len(re.findall(r"\bstone\b", text)) > 2 * len(re.findall(r"\bStone\b", text))
        want = re.sub(r"Mrs Ann Lee|Mr Stone|a@b\.org|10\.1\.2\.3|4111(?: 1111){3}|555-0123" + (r"|\bStone\b" if titled and not often else ""), lambda m: known[m[0]], text)
        assert x["text"] == want


def test_time_follows_the_mentions(spark):
    names = [f"{a}{b}{c}" for a in "BCDFGHJKLM" for b in ("an", "el", "or", "ut") for c in ("ner", "son", "ley", "ton", "man")]
    text = " ".join(f"Mr {names[i % len(names)]} met {names[i * 7 % len(names)]} at 10.0.{i % 200}.{i % 77}" for i in range(40_000))
    import time

    begin = time.time()
    (x,) = pii.replace_entities(spark.createDataFrame([(1, text)], "doc_id long, text string"), "key").collect()
    assert x["n_entities"] == 120_000 and not any(re.search(rf"\b{n}\b", x["text"]) for n in names[:20])
    assert time.time() - begin < 60  # a few seconds of work on a text of 1.4 MB, and the jobs around it


def test_labels_in_any_case(spark):
    texts = ['TOKEN = "9233A8EC9233A8EC9233A8EC9233A8EC9233A8EC"', "access_token=abcd1234wxyz", "DB_PASSWORD: Hunter2Hunter2", "Api-Key=deadbeef00"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: (x["kinds"], x["text"]) for x in pii.replace_entities(docs, "key").collect()}
    assert all(kind == "secret" for kind, _ in got.values()) and all(got[i][1] != x and len(got[i][1]) == len(x) for i, x in enumerate(texts))
    assert re.fullmatch(r'TOKEN = "[0-9A-F]{40}"', got[0][1]) and got[1][1].startswith("access_token=") and got[2][1].startswith("DB_PASSWORD: ") and re.fullmatch("Api-Key=[0-9a-f]{10}", got[3][1])


def test_shards_fit(spark):
    docs = spark.createDataFrame([(i, "x" * (i % 50)) for i in range(500)] + [(1000, "y" * 40)] * 30 + [(2000, "z" * 900)], "doc_id long, text string")
    got = sharding.assign(docs, 200).groupBy("shard").agg(F.sum("bytes").alias("b"), F.count("*").alias("n"), F.max("shard_bytes").alias("s")).collect()
    assert sum(x["n"] for x in got) == 531 and all(x["b"] <= 200 or x["n"] == 1 for x in got) and all(x["b"] == x["s"] for x in got)


def test_licences(spark):
    docs = spark.createDataFrame([(1, "Intro.\nLicensed under the Apache License,\nVersion 2.0. You may not use this file except in compliance with the License. All rights reserved."), (2, "nothing"), (3, None)], "doc_id long, text string")
    got = {x["doc_id"]: (x["licenses"], x["unmatched"]) for x in license.scan(docs).collect()}
    assert got == {1: ("Apache-2.0,Proprietary", ""), 2: ("", ""), 3: ("", "")}


def test_licence_notices(spark):
    notice = "This program is free software%s you can redistribute it and/or modify it under the terms of the GNU %sGeneral Public License as published by\nthe Free Software Foundation%s either version %s of the License, or\n(at your option) any later version.\n"
    texts = {
        notice % (":", "", ",", "3"): ("GPL3,LATER", "GPL-3.0-or-later", ""),
        notice % (";", "", ";", "2"): ("GPLANY,EITHER2,LATER", "GPL-2.0-or-later", ""),
        notice % (";", "Lesser ", ";", "2.1"): ("LGPL,EITHER21,LATER", "LGPL-2.1-or-later", ""),
        notice % (":", "Affero ", ",", "3"): ("AGPL3,LATER", "AGPL-3.0-or-later", ""),
        "Licensed under the Apache License, Version 2.0 or the GNU General Public License version 2": ("APACHE2,GPL2", "Apache-2.0,GPL-2.0", ""),
        "Under CC-BY-NC-SA 4.0": ("CCBYNCSA", "CC-BY-NC-SA-4.0", ""),
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: (x["sentences"], x["licenses"], x["unmatched"]) for x in license.scan(docs).collect()}
    assert got == dict(enumerate(texts.values()))


def test_whole_licence_texts(spark):
    """Each licence of several sentences, as it is usually wrapped, numbered and quoted, gives its identifiers in order by look-up alone."""
    whole = lambda name, k=0: license.WHOLE[name][k]
    texts = {
        f"{whole('MITGRANT')}:\n\n{whole('MITNOTICE')}.\n\n{whole('ASIS').upper()}. IN NO EVENT SHALL ANYBODY BE LIABLE.": "MIT",
        f"{whole('BSDREDIST')}:\n\n1. {whole('BSDSOURCE')}.\n2. {whole('BSDBINARY')}.\n3. {whole('BSDENDORSE')}.\n\n{whole('ASIS', 1).upper()}.": "BSD-3-Clause",
        f"{whole('BSDREDIST')}:\n* {whole('BSDSOURCE')}.\n* {whole('BSDBINARY')}.\n\n{whole('ASIS', 1)}.": "BSD-2-Clause",
        f"{whole('ISCGRANT')}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{whole('ASIS', 2)}.": "ISC",
        f"{whole('ASIS', 3)}. {whole('ZLIBGRANT')}:\n 1. {whole('ZLIBORIGIN')}; you must not claim that you wrote it.\n 2. {whole('ZLIBALTERED')}.\n 3. {whole('ZLIBKEEP')}.": "Zlib",
        f"{whole('UNLICENSE')}.": "Unlicense",
    }
    wrapped = {re.sub(" ", lambda m: "\n    " if m.start() % 60 < 6 else " ", t): v for t, v in texts.items()}
    both = list(texts.items()) + list(wrapped.items())
    got = license.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(both)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [x["licenses"] for x in got] == [v for _, v in both] and not any(x["unmatched"] for x in got)
    assert all(re.search(license.HINT, x) for x in license.LOOKUP)  # what is looked up is never passed over


def test_licence_shorthand(spark):
    texts = {
        "This is GPLv3 code.": "GPL-3.0",
        "GPLv2 only": "GPL-2.0",
        "It is LGPLv2.1, mostly": "LGPL-2.1",
        "(AGPLv3)": "AGPL-3.0",
        "licensed GPLv3+": "GPL-3.0-or-later",
        "LGPL-2.1+ applies": "LGPL-2.1-or-later",
        "GPL v2+": "GPL-2.0-or-later",
        "released under Apache 2.0": "Apache-2.0",
        "under the Apache v2 terms": "Apache-2.0",
        "Apache-2.0 licensed": "Apache-2.0",
        "MIT-licensed code": "MIT",
        "available under MIT": "MIT",
        "a BSD-licensed fork": "BSD",
        "she studied at MIT; Apache land 2.0": "",
        "agplv33 gplv and 2+": "",
    }
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, found string, `left` string")
    assert [x["licenses"] for x in license.scan(docs).orderBy("doc_id").collect()] == list(texts.values())


def test_wrapped_licence_sentences(spark):
    texts = {"This work is dedicated to the public\ndomain.": "CC0-1.0", "# either version 2 or any later\n# version": "", "CC  BY-SA 4.0": "CC-BY-SA-4.0"}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: (x["licenses"], x["unmatched"]) for x in license.scan(docs).collect()}
    assert got == {0: ("CC0-1.0", ""), 1: ("", "EITHER2,LATER"), 2: ("CC-BY-SA-4.0", "")}


def test_token_digest_is_the_library(spark):
    t = simple8b.Tokenizer(vocabulary("word_bpe_49k.json"))
    r = random.Random(9)
    texts = ["".join(r.choice(["the ", "A", "é", ", ", "x1.", "\n", "漢", "don't ", "zzz"]) for _ in range(r.randint(0, 60))) for _ in range(80)]
    rows = [(int(i), x, "s") for i, x in zip(r.sample(range(1000), 80), texts, strict=True)] + [(2000, None, "s"), (2001, "", None), (2001, "", None), (None, "no id", "s"), (3000, "word " * 40_000, "s")]
    got = [tuple(x) for x in simple8b.round_trip(spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5), vocabulary("word_bpe_49k.json")).collect()]
    want, start = [], 0
    for i, x, _ in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*t.library.encode(x or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=str) == sorted(want, key=str)


def test_quality_of_odd_labels(spark):
    good, bad = "river stone walk green tree near the house " * 5, "$$ || $$ || " * 20
    docs = spark.createDataFrame([(i, (good if i % 2 else bad) + str(i), i) for i in range(400)] + [(1, bad, 0)] * 300 + [(None, good, 0), (500, None, 0)], "doc_id long, text string, quality long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(3, None), (None, 1), (5, 7), (999, 0)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    rows = quality.score(docs, model).collect()
    assert len(rows) == docs.count() and [c for c in rows[0].asDict()] == ["doc_id", "held_out", "score", "predicted"]
    for x in rows:
        assert 0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.5)
        assert x["held_out"] == (x["doc_id"] is not None and zlib.crc32(str(x["doc_id"]).encode()) % 3 == 1)
    own = [x for x in rows if x["held_out"] and x["doc_id"] is not None and x["doc_id"] < 400 and x["doc_id"] != 1]
    assert np.mean([x["predicted"] == x["doc_id"] % 2 for x in own]) > 0.97
    again = quality.train(docs.repartition(7), labels.repartition(3))
    assert [float(t.sum()) for t in again.tables] == [float(t.sum()) for t in model.tables]
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 1
    assert quality.keep_good(docs.where("false"), model).count() == 0


def test_huge_texts(spark):
    big = "Ab c." * 300_000
    rows = [(1, big), (2, big.upper()), (2, big.upper()), (3, big[:-1] + "!"), (4, "small"), (5, "SMALL"), (None, big), (6, None)]
    for huge in (1 << 40, 1_000_000):
        got = sorted([(x["doc_id"], x["keep_id"], x["group_size"], x["kept"], x["text_sha256"]) for x in exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), huge).collect()], key=str)
        sha = lambda t: hashlib.sha256((t or "").lower().encode()).hexdigest()
        want = [(1, 2, 4, False), (2, 2, 4, True), (2, 2, 4, False), (None, 2, 4, False), (3, 3, 1, True), (4, 5, 2, False), (5, 5, 2, True), (6, 6, 1, True)]
        texts = dict(rows)
        assert got == sorted([(*w, sha(texts[w[0]])) for w in want], key=str)


def test_rows_that_stay_keep_their_columns(spark):
    rows = [(1, "Text", "a", 1), (1, "text", "b", 2), (1, "TEXT", "c", 3), (None, "x", "d", 4), (None, "X", "e", 5), (2, "other", "f", 6), (3, None, "g", 7), (4, "", "h", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _own string, _keep long")
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns and sorted(tuple(x) for x in left.collect() if x["doc_id"]) == [(1, "TEXT", "c", 3), (2, "other", "f", 6), (4, "", "h", 8)]
    assert [tuple(x) for x in left.collect() if x["doc_id"] is None] == [(None, "X", "e", 5)]
    plain = docs.where("doc_id > 1")
    assert sorted(tuple(x) for x in exact_dedup.drop_copies(plain).collect()) == [(2, "other", "f", 6), (4, "", "h", 8)]


def test_shards_hold_every_row(spark, tmp_path):
    rows = [(1, "a", "en"), (1, "a", "de"), (2, "b", "fr"), (None, "", "x"), (None, None, "y")] + [(9, "z" * 50, str(k)) for k in range(40)] + [(100 + k, "w" * (k % 30), "l") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(6)
    sharding.write_shards(docs, f"file://{tmp_path}/shards", 120)
    got = spark.read.parquet(f"file://{tmp_path}/shards")
    assert sorted([(x["doc_id"], x["text"], x["shard"]) for x in got.collect()], key=str) == sorted(rows, key=str)
    sizes = got.groupBy("_shard").agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).collect()
    assert all((x["b"] or 0) <= 120 or x["n"] == 1 for x in sizes)
    with pytest.raises(ValueError):
        sharding.write_shards(docs.withColumn("_Shard", F.lit(1)), f"file://{tmp_path}/other")


def test_shards_are_those_of_sql(spark):
    import duckdb

    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables here")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}')")
    for limit in (200_000, 20_000):
        want = {(r[0], r[2], r[3], r[5], r[6]) for r in db.execute(sharding.oracle(limit)).fetchall()}
        got = {(x["doc_id"], x["depth"], x["prefix"], x["shard"], x["shard_bytes"]) for x in sharding.assign(spark.read.parquet(path), limit).collect()}
        assert got == want and len({x[3] for x in got}) > 10


def test_licence_texts(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list.\n2. Redistributions in binary form must reproduce the above copyright notice.\n"
    texts = {
        "Licensed under the Eclipse Public License 2.0.": "EPL-2.0",
        "SPDX-License-Identifier: LGPL-2.1-or-later\n\ncode": "LGPL-2.1-or-later",
        "SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one.": "MPL-2.0",
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file)": "BSL-1.0",
        "This software is provided 'as-is', without any express or implied warranty.\nPermission is granted to anyone to use this software for any purpose, including commercial applications:\n1. The origin of this software must not be misrepresented; you must not claim it.\n2. Altered source versions must be plainly marked as such, and more.\n3. This notice may not be removed or altered from any source distribution.": "Zlib",
        bsd + "THIS SOFTWARE IS PROVIDED BY THE AUTHOR \"AS IS\" AND ANY EXPRESS": "BSD-2-Clause",
        bsd + "All rights reserved. Neither the name of the X Group nor the names of its contributors may be used to endorse or promote products. THIS SOFTWARE IS PROVIDED BY Y \"AS IS\".": "BSD-3-Clause,Proprietary",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\nTHE SOFTWARE IS PROVIDED \"AS IS\"": "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\"": "0BSD",
        "Released under the WTFPL; fonts under the SIL Open Font License, Version 1.1.": "WTFPL,OFL-1.1",
        "CC BY-SA 3.0 or Creative Commons Attribution 4.0 International": "CC-BY-SA-3.0,CC-BY-4.0",
        "Common Development and Distribution License (CDDL) Version 1.0; EUPL-1.2; Artistic License 2.0": "CDDL-1.0,EUPL-1.2,Artistic-2.0",
        "nothing to see": "",
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: (x["licenses"], x["unmatched"]) for x in license.scan(docs).collect()}
    assert got == {k: (v, "") for k, v in enumerate(texts.values())}


def test_every_known_sentence_has_a_hint(spark):
    """Plain examples of the patterns: their words, optional ones left out, the first of choices."""
    from re import sub

    def example(p):
        for _ in range(6):
            p = sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)(\?)?", lambda m: "" if m[2] else m[1], p)
        p = sub(r" ?\.\{0,\d+\} ?", " some body ", sub(r".\?", "", p))
        return sub(r"\[(.)[^\]]*\]", r"\1", p)

    names = [(n, example(p.split("|")[0] if "(?:" not in p.split("|")[0] or p.split("|")[0].count("(") == p.split("|")[0].count(")") else p)) for n, p in license.KNOWN]
    docs = spark.createDataFrame([(k, x) for k, (_, x) in enumerate(names)], "doc_id long, text string")
    missed = [(names[r["doc_id"]], r["sentences"]) for r in license.scan(docs).collect() if not r["sentences"]]
    assert not missed


def test_quality_learns(spark):
    r = random.Random(1)
    good = [" ".join(r.choice(["the", "of", "river", "stone", "walk", "green"]) + str(r.randint(0, 99)) for _ in range(60)) for _ in range(200)]
    bad = [" ".join([r.choice(["aa", "bb"])] * 60) for _ in range(200)]
    x = quality.features(pa.array(good + bad))
    y = np.array([1.0] * 200 + [0.0] * 200)
    model = quality.fit(x[::2], y[::2])
    assert ((model.score(x[1::2]) >= 0.5) == y[1::2]).mean() > 0.97
