"""Quality scores by a generalised additive model with pairwise interactions.

Each feature is cut into bins. Boosting goes round the features in turn, and each turn fits a shallow tree on one feature's bins
to the current residuals and adds it, scaled down, to that feature's lookup table; the strongest pairs of features get tables
of their own the same way. A score is a sum of table entries, so scoring is bin lookups and additions over whole columns.
The text alone is read: no label, language, source or id is a feature.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, slices, trimmed
from .words import words

FEATURES = ["log_bytes", "symbols", "bars", "upper", "digits", "spaces", "punctuation", "beyond_ascii", "word_length", "distinct_words", "repeated_next", "words_a_line", "symbol_ended", "log_words"]
#: Labelled rows fitted on at most: those of least hash. The rest of the corpus does not change a model of a few hundred numbers.
MAX_TRAIN = 20_000
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE = 32, 8, 6, 60, 30, 0.15

CLASS = np.zeros((256, 7), np.float32)
for _k, _set in enumerate(["$%&*#@^~=+<>\\/_!", "|", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\n\r", ".,;:?'\"()[]-"]):
    CLASS[np.frombuffer(_set.encode(), np.uint8), _k] = 1
CLASS[128:, 6] = 1
CODE = np.where(CLASS.any(1), CLASS.argmax(1), 7).astype(np.uint8)


def features(column: pa.Array) -> np.ndarray:
    """A row of features for each text; null and empty texts are all zero."""
    data, bounds = bytes_of(column)
    rows = len(bounds) - 1
    out = np.zeros((rows, len(FEATURES)), np.float64)
    size = np.diff(bounds)
    some = np.flatnonzero(size)
    if not len(some):
        return out
    code, starts = CODE[data], bounds[:-1][some]
    share = np.stack([np.add.reduceat(code == k, starts, dtype=np.int64) for k in range(7)], 1) / size[some, None]
    lines = np.add.reduceat(data == 10, starts, dtype=np.int64) + 1
    ended = np.zeros(len(data), bool)
    ended[:-1] = (code[:-1] == 0) & (code[1:] == 4)  # a symbol before white space
    ended[bounds[1:][some] - 1] = False  # of the same text
    blanks = np.maximum(1, np.add.reduceat(code == 4, starts, dtype=np.int64))
    h, at = words(column)
    n = np.diff(at)[some]
    again = np.zeros(len(h) + 1, np.int64)
    if len(h):
        again[1:-1] = h[1:] == h[:-1]
        again[at[:-1][np.diff(at) > 0]] = 0
    totals = np.concatenate(([0], np.cumsum(again[:-1])))
    # Distinct words of all rows at once: first places in (row, word) order.
    row = np.repeat(np.arange(rows), np.diff(at))
    order = np.lexsort((h, row))
    first = np.ones(len(h), bool)
    first[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    distinct = np.bincount(row[order][first], minlength=rows)[some]
    plain = np.maximum(n, 1)
    out[some] = np.column_stack([np.log1p(size[some]), share, size[some] / plain, distinct / np.sqrt(plain), (totals[at[1:]] - totals[at[:-1]])[some] / plain, n / lines, np.add.reduceat(ended, starts, dtype=np.int64) / blanks, np.log1p(n)])
    return out


class Model:
    """Edges of bins, a table for each feature, tables for pairs, and an intercept."""

    def __init__(self, edges, tables, pairs, base):
        self.edges, self.tables, self.pairs, self.base = edges, tables, pairs, base

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = _binned(x, self.edges)
        total = np.full(len(x), self.base)
        for k, t in enumerate(self.tables):
            total += t[bins[:, k]]
        for (a, b), t in self.pairs.items():
            total += t[bins[:, a] * PAIR_BINS // BINS, bins[:, b] * PAIR_BINS // BINS]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)])


def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Best gain of one cut of consecutive bins."""
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(a):
        return 0.0, 0
    c, d = g.sum(), h.sum()
    gain = a * a / (b + 1) + (c - a) ** 2 / (d - b + 1) - c * c / (d + 1)
    return float(gain.max()), int(gain.argmax()) + 1


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """A shallow tree over bins, grown best cut first; the value of each bin."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = max((*_split(g[a:b], h[a:b]), a, b) for a, b in parts)
        if best[0] <= 1e-6:
            break
        parts.remove(best[2:])
        parts += [(best[2], best[2] + best[1]), (best[2] + best[1], best[3])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Cuts one feature, then the other within each half; the better of both orders."""
    best = (-1.0, np.zeros_like(g))
    for turned in (False, True):
        x, y = (g.T, h.T) if turned else (g, h)
        gain, at = _split(x.sum(1), y.sum(1))
        at = at or x.shape[0]
        out, total = np.zeros_like(x), gain
        for half in (slice(0, at), slice(at, None)):
            if x[half].size:
                more, cut = _split(x[half].sum(0), y[half].sum(0))
                total += more
                for side in (slice(0, cut), slice(cut, None)):
                    out[half, side] = x[half, side].sum() / (y[half, side].sum() + 1)
        if total > best[0]:
            best = (total, out.T if turned else out)
    return best


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Without rows of both labels the model is constant: their share, one half where there are none."""
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for k in range(x.shape[1])]
    rate = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(rate / (1 - rate)))
    tables, pairs = [np.zeros(BINS) for _ in edges], {}
    if len(np.unique(y)) < 2:
        return Model(edges, tables, pairs, base)
    bins = _binned(x, edges)
    coarse = bins * PAIR_BINS // BINS
    total = np.full(len(y), base)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for k, t in enumerate(tables):
            g, h = slopes()
            step = RATE * _tree(np.bincount(bins[:, k], g, BINS), np.bincount(bins[:, k], h, BINS))
            t += step
            total += step[bins[:, k]]

    def grid(pair):
        g, h = slopes()
        cell = coarse[:, pair[0]] * PAIR_BINS + coarse[:, pair[1]]
        return cell, *(np.bincount(cell, v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for v in (g, h))

    ranked = sorted(combinations(range(len(edges)), 2), key=lambda pair: -_pair_tree(*grid(pair)[1:])[0])
    for pair in ranked[:PAIRS]:
        pairs[pair] = np.zeros((PAIR_BINS, PAIR_BINS))
    for _ in range(PAIR_ROUNDS):
        for pair, t in pairs.items():
            cell, g, h = grid(pair)
            step = RATE * _pair_tree(g, h)[1]
            t += step
            total += step.ravel()[cell]
    return Model(edges, tables, pairs, base)


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _featured(batches):
    for batch in batches:
        for part in slices(batch):
            x = features(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("quality"), pa.array(list(x), pa.list_(pa.float64()))], names=["quality", "x"])


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Fits on at most max_train labelled rows that are not held out, those of least id hash; null labels and ids are left out.

    Of rows that share an id the least text counts, and of labels of one id the greatest. The sample's ids are bounded by max_train, hence broadcast; its
    features, a row an id, come to the driver.
    """
    chosen = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("text").alias("text")).select("quality", "text")
    got = rows.mapInArrow(trimmed(_featured), "quality int, x array<double>").toPandas()
    x = np.array(got["x"].tolist(), np.float64).reshape(len(got), len(FEATURES))
    order = np.lexsort((*x.T, got["quality"].to_numpy()))  # the same fit in whatever order rows come
    return fit(x[order], got["quality"].to_numpy(np.float64)[order])


def _scored(model: Model):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                score = model.score(features(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text).

    Null and empty texts are scored as texts of nothing; repeated rows score alike; a null doc_id is never held out. Extra
    columns are not read; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(trimmed(_scored(model)), "doc_id long, held_out boolean, score double, predicted int")


def _kept(model: Model):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(model.score(features(part.column("text"))) >= 0.5))

    return run


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs predicted 1, all columns as they are: repeated rows alike, null texts as empty ones; an empty table stays empty."""
    return docs.mapInArrow(trimmed(_kept(model)), docs.schema)
