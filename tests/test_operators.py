"""Sampling, merging, running and storing."""

import pytest
from pyspark.sql import functions as F

from spanmill.operators import corpus, runner
from spanmill.sources import results
from spanmill.streaming import score_stream


def test_sample_size_is_exact_and_strata_are_met(spark):
    df = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 97 == 0, None).otherwise(F.col("id") % 7).alias("s"))
    out = corpus.stratified_sample(df, 100, [F.col("s")], "id").collect()
    assert len(out) == 100 == len({r["id"] for r in out}) and len({r["s"] for r in out}) == 8
    assert corpus.stratified_sample(df, 5000, [F.col("s")], "id").count() == 1000
    assert corpus.stratified_sample(df.limit(0), 10, [F.col("s")], "id").count() == 0


def test_merge_replaces_groups(spark):
    saved = spark.createDataFrame([("a", "x", 1), ("a", "y", 1), ("b", "x", 1)], "model string, condition string, v int")
    fresh = spark.createDataFrame([("a", "x", 2), ("c", "x", 2)], "model string, condition string, v int")
    assert sorted(map(tuple, corpus.merged(saved, fresh).collect())) == [("a", "x", 2), ("a", "y", 1), ("b", "x", 1), ("c", "x", 2)]


def test_batches_fall_back_to_single_prompts(spark):
    def failing(model):  # inside, so that workers need not import this file
        def answer(prompts):
            if any("bad" in p for p in prompts):
                raise ValueError("refused")
            return [None if "none" in p else '[{"type": "PERSON"}]' for p in prompts]

        return answer

    rows = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "none"), (4, None)], "id int, text string").coalesce(1)
    out = runner.answered(runner.generate(runner.prompts(rows, {"cot": "T {text}"}, ["m"]), failing, 10)).collect()
    assert {r["id"]: (r["error"], len(r["preds"])) for r in out} == {1: ("", 1), 2: ("refused", 0), 3: ("no response", 0), 4: ("", 1)}


def test_tools():
    tools = runner.Tools(ok=lambda **k: {"got": k}, broken=lambda **k: 1 / 0)
    assert tools.run("ok", a=1) == {"got": {"a": 1}} and "error" in tools.run("broken") and "error" in tools.run("none")


def test_benchmark_sink_refuses_repeated_rows(spark, tmp_path):
    row = ("a", "s", 1, ["PERSON"], ["PERSON"])
    df = spark.createDataFrame([row, row], "id string, source string, original_index long, ground_truth array<string>, canonical array<string>")
    with pytest.raises(ValueError, match="twice"):
        results.write_benchmark(df, str(tmp_path / "b"))


def test_stream_scores_what_a_batch_scores(spark, tmp_path):
    kind = "key int, preds array<struct<type:string,text:string,start:int,stop:int>>, gold array<struct<type:string,text:string,start:int,stop:int>>"
    df = spark.createDataFrame([(1, [("NAME", "x", 0, 4)], [("PERSON", "x", 0, 4)]), (2, [], [("URL", "x", 1, 2)])], kind)
    df.write.parquet(str(tmp_path / "in"))
    q = score_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert {r["key"]: r["f1"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: 1.0, 2: 0.0}
