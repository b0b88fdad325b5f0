"""Corpus readers, loaders, the transactional sink and configuration."""

import json

import pytest
from pyspark.sql import functions as F

from spanmill.operators import config
from spanmill.sources import corpora, loaders, results, run_sink


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_corpora_filter_at_the_scan(spark, tmp_path):
    rows = [("t1", "[{'label': 'A', 'x': None}]", 1, "us"), ("t2", '[{"entity_type": "B"}, {"category": "C"}, {}]', 2, " US "), ("t3", "[]", 3, "intl"), ("t4", None, 4, None), ("t5", "no list", 5, "us")]
    spark.createDataFrame(rows, "text string, spans string, original_index long, locale string").withColumn("unread", F.lit("x")).write.parquet(str(tmp_path / "b"))
    got = corpora.read_corpus(spark, str(tmp_path / "b"), "spans", "us", "corpus_b")
    assert sorted((r["id"], r["types"]) for r in got.collect()) == [("b_1", ["A"]), ("b_2", ["B", "C", "UNK"]), ("b_5", [])]
    exact = corpora.read_exact(spark, str(tmp_path / "b"), "spans", ["us"])
    assert {r["id"] for r in exact.collect()} == {"b_1", "b_5"}
    assert "PushedFilters: [EqualTo(locale,us)]" in plan(exact).replace("IsNotNull(locale), ", "") or "EqualTo(locale,us)" in plan(exact) or "In(locale" in plan(exact)
    assert "unread" not in plan(got) and "IsNotNull(locale)" in plan(got)
    assert corpora.read_corpus(spark, str(tmp_path / "b"), "spans").count() == 5
    many = spark.range(100).select(F.concat(F.lit("s"), F.col("id") % 2).alias("source"), F.array(*[F.lit(f"T{i}") for i in range(12)]).alias("types"))
    top = corpora.summary(many)
    assert top.count() == 20 and "WindowGroupLimit" in plan(top)


def test_loaders_fall_back_and_fail(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        loaders.load_analysis(spark, "main", "v1", str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "c.json"), str(tmp_path / "d"))
    none = loaders.existing_results(spark, "main", "v1", str(tmp_path / "c.json"), str(tmp_path / "a"))
    assert none.collect() == [] and none.columns == loaders.LOADED
    records = [
        {"sample_id": "s1", "source": None, "model": "m", "condition": "cot", "predictions": [{"type": "A", "text": "x", "start": "1", "end": 2}, {"text": "no type"}, 3], "ground_truth": '[{"type": "G"}]', "scores": {"f1": 1}, "error": None, "tool_executed": True},
        {"sample_id": "s2", "model": "m", "condition": "cot", "predictions": None, "ground_truth": "not a list", "scores": [], "elapsed_seconds": 1.5, "conversation_turns": 2},
    ]
    (tmp_path / "c.json").write_text(json.dumps(records))
    got = {r["sample_id"]: r for r in loaders.load_analysis(spark, "main", "v1", None, None, str(tmp_path / "c.json")).collect()}
    assert [(p["type"], p["start"], p["stop"]) for p in got["s1"]["preds"]][0] == ("A", 1, 2) and got["s1"]["gold"][0]["type"] == "G" and got["s1"]["scores"] == '{"f1":1}' and got["s1"]["tool"]
    assert (got["s2"]["preds"], got["s2"]["gold"], got["s2"]["scores"], got["s2"]["tool"], got["s2"]["elapsed"], got["s2"]["turns"]) == ([], [], None, False, 1.5, 2)
    assert [r["sample_id"] for r in loaders.missing_gold(loaders.local(spark, str(tmp_path / "c.json"))).collect()] == ["s2"]


def test_benchmark_bare_or_wrapped(spark, tmp_path):
    rows = [{"id": "a", "ground_truth": [{"type": "X"}], "pii_codex_ground_truth": '["P", "Q"]'}, {"sample_id": "b", "ground_truth": '[{"type": "Y"}]'}, {"id": "", "ground_truth": None, "canonical": [{"type": "Z", "start": 3}]}]
    for name, held in (("bare", rows), ("wrapped", {"note": [1], "samples": rows})):
        (tmp_path / f"{name}.json").write_text(json.dumps(held, indent=1))
        bench = loaders.read_benchmark(spark, str(tmp_path / f"{name}.json"))
        got = {r["key"]: ([g["type"] for g in r["gold"]], r["types"]) for r in bench.select("key", loaders.gold_of(F.col("canonical"), F.col("ground_truth")).alias("gold"), loaders.canonical_types(F.col("canonical")).alias("types")).collect()}
        assert got == {"a": (["P", "Q"], ["P", "Q"]), "b": (["Y"], None), "2": (["Z"], None)}


def test_sink_is_all_or_nothing(spark, tmp_path):
    path, kind = str(tmp_path / "runs"), "id long, v string"
    df = spark.range(100).select("id", F.concat(F.lit("v"), "id").alias("v")).repartition(4)
    run_sink.write_once(df, path, "one")
    run_sink.write_once(df.filter("id < 10"), path, "one")  # is there already
    broken = df.withColumn("v", F.when(F.col("id") == 77, F.raise_error(F.lit("broken"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="broken"):
        run_sink.write_once(broken, path, "two")
    assert run_sink.read_runs(spark, path, kind).count() == 100 and [r["run_id"] for r in run_sink.manifests(spark, path).collect()] == ["one"]
    assert run_sink.vacuum(spark, path) == 0 and len(list((tmp_path / "runs/files").iterdir())) <= 2  # a killed task may end late
    run_sink.write_once(df.limit(0), path, "none", "pilot", "v2")
    run_sink.write_once(df.filter("id < 10"), path, "one", overwrite=True)
    assert run_sink.read_runs(spark, path, kind, "one").count() == 10 and run_sink.read_runs(spark, path, kind, "none").count() == 0
    assert run_sink.vacuum(spark, path, -60) >= 1 and run_sink.read_runs(spark, path, kind, "one").count() == 10
    assert len(list((tmp_path / "runs/files").iterdir())) == 1
    with pytest.raises(Exception, match="run_id"):
        run_sink.write_once(df, path, "a/b")


def test_a_run_that_is_there_is_not_computed_again(spark, tmp_path):
    """Before, its rows were computed and written once more, and then dropped."""
    path, seen = str(tmp_path / "runs"), spark.sparkContext.accumulator(0)
    df = spark.range(100).mapInArrow(lambda batches: (seen.add(b.num_rows) or b for b in batches), "id long")
    for _ in range(2):
        run_sink.write_once(df, path, "one")
    assert seen.value == 100 and run_sink.read_runs(spark, path, "id long").count() == 100
    run_sink.write_once(df, path, "one", overwrite=True)
    assert seen.value == 200 and run_sink.read_runs(spark, path, "id long").count() == 100


def test_configuration_layers(tmp_path):
    low = {"a": 1, "t": {"x": 1, "y": {"z": 2}}, "l": [1, 2]}
    assert config.merged(low, {"t": {"y": {"w": 3}}, "l": [3]}) == {"a": 1, "t": {"x": 1, "y": {"z": 2, "w": 3}}, "l": [3]} and low["l"] == [1, 2]
    data = {"harness": {"common": {"models": ["m"], "templates": {"cot": "a"}, "batch": 1}, "cuda": {"batch": 9}, "cpu": {"templates": {"few_shot": "b"}}}}
    (tmp_path / "config").mkdir()
    (tmp_path / "config.json").write_text(json.dumps(data))
    own = config.from_folder(tmp_path / "config", "cpu")
    assert own.templates == {"cot": "a", "few_shot": "b"} and own.batch == 1 and config.from_folder(tmp_path, "mlx").batch == 9
    for bad, message in (({}, "common is missing"), ({"harness": {"common": 3}}, "common is missing"), ({"harness": {"common": {}, "cpu": [1]}}, "cpu")):
        with pytest.raises(config.ConfigError, match=message):
            config.layered(bad, "cpu")
    with pytest.raises(config.ConfigError, match="batch"):
        config.known({"batch": "12"})
    with pytest.raises(config.ConfigMissing):
        config.from_folder(tmp_path / "none", "cpu")
    (tmp_path / "flat").mkdir()
    (tmp_path / "flat/cpu.json").write_text('{"models": ["m"], "other": 1}')
    assert config.from_folder(tmp_path / "flat", "cpu").models == ["m"]
    (tmp_path / "flat/cpu.json").write_text("{")
    with pytest.raises(config.ConfigError):
        config.from_folder(tmp_path / "flat", "cpu")
    yaml = pytest.importorskip("yaml")
    (tmp_path / "flat/cpu.yaml").write_text(yaml.safe_dump({"models": ["y"], "templates": {"cot": "c"}}))
    assert config.from_folder(tmp_path / "flat", "cpu").models == ["y"]


def test_appendix_rows(spark):
    from spanmill.functions import stats

    rows = [("m_0", "a", 0.1 * (i % 5) - 0.1) for i in range(50)] + [("m_0", "b", 0.0)] * 3 + [("m_1", "a", 1.0 + i) for i in range(40)]
    got = {(r["model"], r["comparison"]): r for r in stats.appendix(spark.createDataFrame(rows, "model string, comparison string, delta double").groupBy("model", "comparison")).collect()}
    assert got["m_0", "b"]["t"] is None and got["m_0", "b"]["line"] == "m\\_0 & b & - & - & - & 0.0\\% \\\\"
    assert got["m_1", "a"]["p"] == "<0.0001" and "$<0.0001$" in got["m_1", "a"]["line"] and got["m_0", "a"]["line"].startswith("m\\_0 & a & $+")


def test_published_scores_are_objects(spark, tmp_path):
    df = spark.createDataFrame([("s1", "m", '{"f1": 1}'), ("s2", "m", "[]"), ("s3", "m", "")], "sample_id string, model string, scores string")
    own = df.withColumns({c: F.lit(None).cast(t) for c, t in (("source", "string"), ("condition", "string"), ("predictions", "string"), ("ground_truth", "string"), ("raw_response", "string"), ("error", "string"), ("tool_executed", "boolean"), ("skill_viewed", "boolean"), ("conversation_turns", "long"), ("elapsed_seconds", "double"))})
    own.withColumns({"run_type": F.lit("main"), "prompt_version": F.lit("v1")}).write.partitionBy("run_type", "prompt_version").parquet(str(tmp_path / "s"))
    assert {r["sample_id"]: r["scores"] for r in loaders.published(spark, str(tmp_path / "s"), "main", "v1", None).collect()} == {"s1": '{"f1": 1}', "s2": None, "s3": None}
    assert results.RUN.startswith("sample_id")
