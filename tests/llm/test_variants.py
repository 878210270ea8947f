import random
import re
import zlib
from collections import Counter

from muster.llm import variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(words):
    out, forms = {}, {}
    for w, n in words.items():
        close = [v for v in words if near(w, v)]
        best = min(close, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best and words[best] >= 2 * n else None
        out[w] = [forms[w], n, len(close), words[best] if forms[w] else None]
    for w, x in out.items():
        root = w
        while forms[root]:
            root = forms[root]
        x.insert(1, root)
    return sorted((w, *x) for w, x in out.items())


def collected(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0])


def test_groups_are_those_of_brute_force(spark):
    for seed, letters in ((1, "ab"), (2, "abcd"), (3, "aéÿ÷")):
        r = random.Random(seed)
        words = {"".join(r.choice(letters) for _ in range(r.randrange(1, 9))): r.choice((3, 3, 6, 12, 12, 100)) for _ in range(260)}
        words |= {x: 3 for x in ("aaaaa", "aaaaaa", "aaaaaaa")} | {"b" * 40: 50, "b" * 41: 3, "b" * 39 + "a": 7, "b" * 20 + "a" + "b" * 20: 9}
        assert collected(variants.group_variants(spark.createDataFrame(list(words.items()), "word string, n long"))) == grouped(words)


def test_whole_query_on_odd_rows(spark):
    r = random.Random(5)
    base = ["".join(r.choice("aeinrst") for _ in range(r.randrange(5, 8))) for _ in range(60)]
    rows = [(i % 40, " ".join(r.choice(base) for _ in range(r.randrange(40))).title(), "x", "y") for i in range(120)]
    rows += [(None, "Größe größe GRÖßE x×y÷z Größe", None, None), (None, None, "", ""), (7, "", "", ""), (8, ("q" * 70_000 + " ") * 3 + "w" * 69_999 + "w", "", ""), (9, "q" * 69_999 + ". " + "q" * 69_999 + "1" + "q" * 69_999, "", "")]
    counts = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    assert any(w.startswith("q") for w in words)
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n string")
    assert collected(variants.spelling_variants(docs)) == grouped(words)
    assert variants.spelling_variants(docs.where("false")).count() == 0


def test_light_words_are_few(spark):
    """No word is light at more nodes than the logarithm of the number of words, though all share one prefix."""
    words = [("prefix" + "".join(random.Random(i).choice("abc") for _ in range(9)), 3) for i in range(3000)]
    df = spark.createDataFrame(sorted(set(words)), "word string, n long")
    seen = []

    class Spy(variants.Scratch):
        def write(self, frame, name):
            out = super().write(frame, name)
            if name == "merged":
                seen.append(out.groupBy("word").count().agg({"count": "max"}).first()[0])
            return out

    variants.near_words(Spy(spark, "spied"), df).count()
    assert seen[0] <= 3 * 12
