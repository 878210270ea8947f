import io
import json
import random

import numpy as np

from muster.__main__ import run
from muster.engine import Fake
from muster.operators import media

LETTERS = "абвгдежзиклмнопрстуфхцчшэюя"


def model():
    """A model for `run` that answers each request with words of its own."""

    def answer(request):
        r = random.Random(request["user"])
        words = lambda n: " ".join("".join(r.choice(LETTERS) for _ in range(7)) for _ in range(n))
        return json.dumps({"title": words(2), "description": words(32), "stages": words(25)}, ensure_ascii=False)

    return Fake(answer)


def test_a_domain_from_plan_to_upload(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"params": [{"key": "length", "identity": True, "domain": {"kind": "int", "min": 1, "max": 900}}]}))

    def said(*words):
        out = io.StringIO()
        run(spark, [f"file://{tmp_path}/store", *map(str, words)], out)
        return [json.loads(x) for x in out.getvalue().splitlines()]

    (planned,) = said("plan", "program", tmp_path / "d.json", 5, "--seed", 3, "--threshold", 0.5)
    assert planned["pending"] == 5
    (done,) = said("run", planned["session"], "program", tmp_path / "d.json", "test_commands:model")
    assert done["done"] == 5 and done["status"] == "done"
    assert said("upload", planned["session"], "program", tmp_path / "d.json", f"file://{tmp_path}/out") == [{"written": 5}]
    kept = [json.loads(r["record"]) for r in spark.read.parquet(f"{tmp_path}/out/programs").collect()]
    assert len(kept) == 5 and all(set(x) >= {"length", "title", "description", "stages", "entity_kind"} for x in kept)


def test_work_on_files(spark, tmp_path):
    def said(*words):
        out = io.StringIO()
        run(spark, [f"file://{tmp_path}/store", *map(str, words)], out)
        return [json.loads(x) for x in out.getvalue().splitlines()]

    def lines(name, rows):
        (tmp_path / name).write_text("".join(json.dumps(r) + "\n" for r in rows))
        return tmp_path / name

    texts = lines("texts.jsonl", [{"id": "a", "text": "one two three four five"}, {"id": "b", "text": "one two three four six"}, {"id": "c", "text": "nothing like the others"}])
    summary, pair = said("similarity", texts)
    assert summary["n"] == 2 and (pair["a"], pair["b"], pair["score"]) == ("a", "b", 0.5)

    pools = tmp_path / "pools"
    pools.mkdir()
    lines("pools/places.jsonl", [{"key": f"p{i}", "segment": "low", "region": "r", "capacity": 12, "year_built": 1980} for i in range(4)])
    lines("pools/programs.jsonl", [{"key": f"g{i}", "segment": "low", "focus": "plain"} for i in range(4)])
    lines("pools/people.jsonl", [{"key": f"e{i}", "role": ["doctor", "psychologist", "consultant"][i % 3], "full_name": f"Name{i} X", "age": 40, "fits": {"plain": i / 100}, "specialist": True, "psychiatric": True} for i in range(60)])
    lines("pools/directors.jsonl", [{"key": f"d{i}", "full_name": f"Chief{i} X", "age": 60, "home_region": "r", "founder": True, "leading_years": 5} for i in range(4)])
    assert said("compose", pools, tmp_path / "centres", "--shards", 2) == [{"centres": 4}]

    people = lines("people.jsonl", [{"natural_key": "k1", "name": "A"}, {"natural_key": "k2", "name": "B"}])
    (tmp_path / "map.json").write_text(json.dumps({"k1": "one.png", "k9": "nine.png"}))
    assert said("photos", people, tmp_path / "map.json", tmp_path / "linked") == [{"records": 2, "with_photo": 1}]

    (tmp_path / "images").mkdir()
    (tmp_path / "images" / "a.png").write_bytes(media.write_png(np.zeros((8, 8, 3), np.uint8)))
    (tmp_path / "images" / "b.png").write_bytes(b"no image")
    assert said("refinish", tmp_path / "images", tmp_path / "finished") == [{"finished": 1, "refused": 1}]
