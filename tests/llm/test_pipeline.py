import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from muster.llm import quality, spm  # noqa: E402
from muster.llm.queries import vocabulary  # noqa: E402


def _shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def _edits(item, text):
    """Least edits of item against any stretch of text."""
    row = np.zeros(len(text) + 1, np.int64)
    codes, d = np.array(list(text)), np.arange(len(text) + 1)
    for k, c in enumerate(item):
        new = np.append(k + 1, np.minimum(row[1:] + 1, row[:-1] + (codes != c)))
        row = np.minimum.accumulate(new - d) + d
    return int(row.min())


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    r = random.Random(11)
    words = ["".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 9))) for _ in range(600)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    docs = {i: prose(r.randint(40, 160)) for i in range(200)}
    docs |= {i: " ".join([r.choice(["$$", "zz|", "%%"])] * r.randint(30, 90)) for i in range(200, 400)}
    items = {k: prose(30) for k in range(3)}
    for i in range(400, 420):  # copies but for the case
        docs[i] = docs[i - 400].upper() if i % 2 else docs[i - 400]
    for i in range(420, 440):  # near copies: one word changed
        w = docs[i - 420 + 40].split()
        w[len(w) // 2] = "changed"
        docs[i] = " ".join(w)
    for i in range(440, 446):  # passages of the benchmark, whole and with edits
        item = items[i % 3]
        docs[i] = prose(30) + " " + (item if i % 2 else item[:40] + "xx" + item[43:]) + " " + prose(30)
    docs[446] = prose(40) + " " + items[0][:60]  # a part alone is no leak
    docs[447], docs[448] = None, ""
    labels = {i: int(i < 200) for i in range(400)}
    folder = tmp_path_factory.mktemp("corpus")
    pd.DataFrame({"doc_id": list(docs), "text": list(docs.values()), "lang": "en", "source": "s", "n_chars": [len(t or "") for t in docs.values()]}).to_parquet(folder / "documents.parquet")
    pd.DataFrame({"doc_id": list(labels), "quality": list(labels.values()), "toxic": 0}).astype({"quality": "int32"}).to_parquet(folder / "labels.parquet")
    pd.DataFrame({"item_id": list(items), "text": list(items.values())}).to_parquet(folder / "benchmark.parquet")
    return str(folder), docs, labels, items


def _brute(docs, labels, items):
    rows = [i for i in labels if zlib.crc32(str(i).encode()) % 3 != 1]
    x, y = quality.features(pa.array([docs[i] for i in rows])), np.array([labels[i] for i in rows], np.float64)
    order = np.lexsort((*x.T, y))
    model = quality.fit(x[order], y[order])
    stages = [{i: t for i, t in docs.items() if model.score(quality.features(pa.array([t], pa.string())))[0] >= 0.5}]
    low = lambda t: (t or "").encode().lower()
    last = {low(t): i for i, t in sorted(stages[-1].items())}
    stages.append({i: t for i, t in stages[-1].items() if last[low(t)] == i})
    sets, label = {i: _shingles(t) for i, t in stages[-1].items()}, {i: i for i in stages[-1]}
    for i in sets:
        for j in sets:
            if i < j and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = {k: a if v == b else v for k, v in label.items()}
    stages.append({i: t for i, t in stages[-1].items() if label[i] == i})
    stages.append({i: t for i, t in stages[-1].items() if all(_edits(item, (t or "").lower()) > int(0.1 * len(item)) for item in items.values())})
    return stages


def test_pipeline_is_brute_force(spark, corpus):
    folder, docs, labels, items = corpus
    want = _brute(docs, labels, items)
    sizes = [len(s) for s in want]
    assert len(docs) > sizes[0] > sizes[1] > sizes[2] > sizes[3] > 100  # every stage has something to do
    got = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        columns, got = got.columns, stage(spark, got, folder)
        assert got.columns == columns, name
        assert {r["doc_id"] for r in got.select("doc_id").collect()} == set(want[k]), name
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(out) == set(want[-1])
    c = spm.coder(vocabulary("piece_bpe_32k.model"))
    for i, r in out.items():
        back, _ = c.decode(np.array(r["ids"], np.int64), np.array([0, len(r["ids"])]))
        assert r["round_trip"] and back.tobytes() == ((" " + want[-1][i]).encode() if want[-1][i] else b"")
        assert r["n_pieces"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
