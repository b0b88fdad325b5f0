"""The splittable reader of JSON arrays against json.loads."""

import json
import random

import numpy as np
import pytest

from spanmill.sources import json_array

TRICKY = ['a "quoted" text', "back\\slash", 'ends with \\', '\\"', "[1, 2", "}], {", "é\U0001f600 ünï", "", "\\\\\"", 'x\\\\"y,', '"samples": [', "\n\t "]


def objects(n, seed=1):
    rng = random.Random(seed)
    return [{"id": rng.choice([f"i{i}", None, ""]), "text": "".join(rng.choice(TRICKY) for _ in range(rng.randint(0, 6))), "more": [[rng.randint(0, 9)], {"k,": "]"}]} for i in range(n)]


def test_quotes_are_found_at_every_cut():
    raw = json.dumps(objects(40)).encode()
    b = np.frombuffer(raw, np.uint8)
    whole = set(json_array.quotes(b).tolist())
    for cut in range(1, len(raw), 7):
        before = len(raw[:cut]) - len(raw[:cut].rstrip(b"\\"))
        assert {cut + i for i in json_array.quotes(b[cut:], before).tolist()} == {i for i in whole if i >= cut}


@pytest.mark.parametrize("size", [7, 100, 1 << 20])
@pytest.mark.parametrize("form", ["plain", "indent", "wrapped"])
def test_elements_equal_one_reader(spark, tmp_path, size, form):
    held = objects(12 if size == 7 else 60)
    whole = {"before": {"samples": [1, 2], "x": '"samples": ['}, "note": ["a", {"b": []}], "samples": held, "after": [[1], 2]} if form == "wrapped" else held
    path = tmp_path / "a.json"
    path.write_text(json.dumps(whole, indent=2 if form != "plain" else None, ensure_ascii=form == "plain"))
    got = json_array.elements(spark, str(path), size=size).collect()
    assert [json.loads(r["element"]) for r in sorted(got, key=lambda r: r["position"])] == held
    assert sorted(r["position"] for r in got) == list(range(len(held)))


@pytest.mark.parametrize("text,expected", [("[]", []), (" [ \n ] ", []), ("[1]", [1]), ('["a,b", null, [], {}, "]"]', ["a,b", None, [], {}, "]"]), ('{"x": 1}', []), ('{"samples": []}', []), ('{"samples" : [ 3 ] }', [3])])
def test_small_arrays(spark, tmp_path, text, expected):
    (tmp_path / "a.json").write_text(text)
    got = json_array.elements(spark, str(tmp_path / "a.json"), size=3).collect()
    assert [json.loads(r["element"]) for r in sorted(got, key=lambda r: r["position"])] == expected


def test_a_long_element_and_many_files(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" * (200_000 if i == 3 else i), None) for i in range(20)], "id long, text string, none string").repartition(3)
    json_array.write_arrays(df, str(tmp_path / "out"))
    back = json_array.by_id(json_array.read_array(spark, str(tmp_path / "out"), "id long, text string, none string", size=1000), "none", "id")
    assert sorted((r["id"], len(r["text"]), r["none"], r["key"]) for r in back.collect()) == [(i, 200_000 if i == 3 else i, None, str(i)) for i in range(20)]
    json_array.write_arrays(df.limit(0), str(tmp_path / "none"))
    assert json_array.elements(spark, str(tmp_path / "none")).count() == 0


def test_ids_fall_back_to_positions(spark, tmp_path):
    held = objects(30)
    (tmp_path / "a.json").write_text(json.dumps(held))
    got = json_array.by_id(json_array.read_array(spark, str(tmp_path / "a.json"), "id string, text string", size=64), "id").collect()
    assert {r["position"]: r["key"] for r in got} == {i: o["id"] or str(i) for i, o in enumerate(held)}


def test_many_small_ranges_share_tasks(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": str(i)} for i in range(3000)]))
    got = json_array.elements(spark, str(tmp_path / "a.json"), size=16)  # thousands of ranges
    assert got.rdd.getNumPartitions() <= 64  # before: one for each range
    assert [r["position"] for r in got.orderBy("position").collect()] == list(range(3000))
    whole = json_array.elements(spark, str(tmp_path / "a.json"))
    assert whole.count() == 3000 and json_array._tasks(1, 8) == 1 and json_array._tasks(100_000, 8) == 1562


def test_ranges_of_large_files_stay_small_in_memory(tmp_path):
    import tracemalloc

    import pandas as pd

    size, path = json_array._size(10**11, 12), str(tmp_path / "a.json")
    (tmp_path / "a.json").write_text("[" + ", ".join(['{"type": "URL", "start": 1}'] * (size // 27)) + "]")
    ranges = pd.DataFrame([(path, 0, 0, 0, size, False, 0, 0, 1)], columns=["path", "number", "first", "start", "stop", "inside", "depth", "opens", "base"])
    tracemalloc.start()
    for run in (json_array._scanned, json_array._counted):
        list(run([ranges]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
