import math
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa

from muster.llm import quality

CLASSES = ["$%&*#@^~=+<>\\/_!", "|", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\n\r", ".,;:?'\"()[]-"]


def plain_features(text):
    raw = (text or "").encode()
    if not raw:
        return [0.0] * len(quality.FEATURES)
    kind = [next((k for k, s in enumerate(CLASSES) if b < 128 and chr(b) in s), 6 if b >= 128 else 7) for b in raw]
    share = [kind.count(k) / len(raw) for k in range(7)]
    words = re.findall("[a-z0-9\x80-\U0010ffff]+", text.lower())
    n, spaces = len(words), kind.count(4)
    return [math.log1p(len(raw)), *share, len(raw) / max(1, n), len(set(words)) / math.sqrt(max(1, n)), sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, n), n / (raw.count(b"\n") + 1), sum(a == 0 and b == 4 for a, b in zip(kind, kind[1:], strict=False)) / max(1, spaces), math.log1p(n)]


def test_features_are_those_of_plain_python():
    r = random.Random(1)
    bits = ["one", "two", "two", "Three", "é", "straße", "$$", "|", "12", "\n", "\t", "a|b", "!", "…", "x.y", "(z)"]
    texts = [None, "", " ", "$ ", "word", "word word", "|||", "\n\n", "é" * 50] + ["".join(r.choice(bits) + r.choice(["", " ", "  "]) for _ in range(r.randrange(1, 80))) for _ in range(150)]
    assert np.allclose(quality.features(pa.array(texts, pa.string())), [plain_features(t) for t in texts], atol=1e-12)


def _gain(g, h, c, d):
    return g * g / (h + 1) + (c - g) ** 2 / (d - h + 1) - c * c / (d + 1)


def plain_split(g, h):
    """The first of the cuts of greatest gain."""
    best = (0.0, 0)
    for k in range(1, len(g)):
        gain = _gain(sum(g[:k]), sum(h[:k]), sum(g), sum(h))
        if k == 1 or gain > best[0]:
            best = (gain, k)
    return best


def plain_tree(g, h):
    parts = [(0, len(g))]
    while len(parts) < 4:
        found = max((*plain_split(g[a:b], h[a:b]), a, b) for a, b in parts)
        if found[0] <= 1e-6:
            break
        _, cut, a, b = found
        parts.remove((a, b))
        parts += [(a, a + cut), (a + cut, b)]
    out = [0.0] * len(g)
    for a, b in parts:
        out[a:b] = [sum(g[a:b]) / (sum(h[a:b]) + 1)] * (b - a)
    return out


def plain_pair(g, h):
    best = None
    for turned in (False, True):
        x, y = ([list(c) for c in zip(*t, strict=True)] if turned else t for t in (g, h))
        total, at = plain_split([sum(r) for r in x], [sum(r) for r in y])
        at = at or len(x)
        out = [[0.0] * len(x[0]) for _ in x]
        for a, b in ((0, at), (at, len(x))):
            if a < b:
                gs, hs = [sum(r[k] for r in x[a:b]) for k in range(len(x[0]))], [sum(r[k] for r in y[a:b]) for k in range(len(x[0]))]
                gain, cut = plain_split(gs, hs)
                total += gain
                for c, d in ((0, cut), (cut, len(gs))):
                    for i in range(a, b):
                        out[i][c:d] = [sum(gs[c:d]) / (sum(hs[c:d]) + 1)] * (d - c)
        if best is None or total > best[0]:
            best = (total, [list(c) for c in zip(*out, strict=True)] if turned else out)
    return best


def plain_scores(x, y):
    """Scores of the rows fitted on, by loops over rows and bins."""
    wide = range(len(x[0]))
    edges = [sorted(set(np.quantile([r[k] for r in x], np.linspace(0, 1, quality.BINS + 1)[1:-1]).tolist())) for k in wide]
    bins = [[sum(e <= r[k] for e in edges[k]) for k in wide] for r in x]
    rate = (sum(y) + 0.5) / (len(y) + 1)
    total = [math.log(rate / (1 - rate))] * len(y)

    def sums(cell, size):
        g, h = [0.0] * size, [0.0] * size
        for i, c in enumerate(cell):
            p = 1 / (1 + math.exp(-total[i]))
            g[c] += y[i] - p
            h[c] += max(p * (1 - p), 1e-6)
        return g, h

    for _ in range(quality.ROUNDS):
        for k in wide:
            step = plain_tree(*sums([b[k] for b in bins], quality.BINS))
            total = [t + quality.RATE * step[b[k]] for t, b in zip(total, bins, strict=True)]
    n = quality.PAIR_BINS

    def grid(pair):
        cell = [(b[pair[0]] * n // quality.BINS) * n + b[pair[1]] * n // quality.BINS for b in bins]
        g, h = sums(cell, n * n)
        return cell, plain_pair([g[i * n : i * n + n] for i in range(n)], [h[i * n : i * n + n] for i in range(n)])

    ranked = sorted(combinations(wide, 2), key=lambda pair: -grid(pair)[1][0])[: quality.PAIRS]
    for _ in range(quality.PAIR_ROUNDS):
        for pair in ranked:
            cell, (_, table) = grid(pair)
            total = [t + quality.RATE * table[c // n][c % n] for t, c in zip(total, cell, strict=True)]
    return [1 / (1 + math.exp(-t)) for t in total]


def test_fit_is_a_plain_boosting_loop(monkeypatch):
    monkeypatch.setattr(quality, "ROUNDS", 6)
    monkeypatch.setattr(quality, "PAIR_ROUNDS", 4)
    r = random.Random(2)
    x = [[r.random(), r.gauss(0, 1), float(r.randrange(3)), r.random() ** 3] for _ in range(70)]
    y = [int(a + 0.3 * b + (c == 1) * d + 0.2 * r.random() > 0.7) for a, b, c, d in x]
    got = quality.fit(np.array(x), np.array(y, np.float64)).score(np.array(x))
    assert np.allclose(got, plain_scores(x, y), atol=1e-9)


def test_held_out_labels_change_nothing(spark):
    r = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(r.choice(["good", "words", "here"] if i % 2 else ["$$", "||", "zz"]) for _ in range(20)), "x", 0) for i in range(120)], "doc_id long, text string, quality string, held_out int")
    labels = [(i, i % 2) for i in range(120)]
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q) for i, q in labels]
    a, b = ([tuple(x) for x in quality.score(docs, quality.train(docs, spark.createDataFrame(rows, "doc_id long, quality int"))).orderBy("doc_id").collect()] for rows in (labels, flipped))
    assert a == b and all(p == i % 2 and out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, out, _, p in a)
    few = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"), max_train=10)
    assert isinstance(few, quality.Model)
