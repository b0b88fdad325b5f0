"""Queries of readers, loaders, sinks and configuration: each writes what is derived from the tables to the shared folder and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanmill.functions import spans
from spanmill.operators import config, corpus, grid, match, runner, samples
from spanmill.plans.corpus_queries import BIN, CORPUS_SQL, STRICT_SQL, corpus_rows, sample_sql, typed
from spanmill.plans.fixtures import CARDS_SQL, RECORDS_SQL, cards, records
from spanmill.plans.registry import query
from spanmill.plans.run_queries import obedient
from spanmill.sources import corpora, json_array, loaders, results, run_sink
from spanmill.sources.paths import shared_dir

# ---- corpora ----

_LANG = "CASE key % 5 WHEN 0 THEN 'English' WHEN 1 THEN ' english ' WHEN 2 THEN 'Dutch' WHEN 3 THEN NULL ELSE 'ENGLISH' END"


def _masks(spark, d):
    own = corpus_rows(spark, d).withColumn("language", F.expr(_LANG))
    item = "transform(masks, m -> struct(m.label as label, 'x' as value, 0L as start, 1L as end))"
    return own.select(F.col("text").alias("source_text"), F.expr(item).alias("privacy_mask"), "original_index", "language", F.lit("unread").alias("target_text"))


@query("a1_masks_corpus", f"WITH {CORPUS_SQL} SELECT 'a_' || key AS id, original_index, text, array_to_string(types, ',') AS types FROM corpus WHERE key % 5 IN (0, 1, 4)")
def _(spark, d):
    _masks(spark, d).write.parquet(path := shared_dir(spark) + "/masks")
    return corpora.read_corpus(spark, path, "masks", "English").select("id", "original_index", "text", F.array_join("types", ",").alias("types"))


@query("a1_spans_corpus", f"WITH {CORPUS_SQL} SELECT 'b_' || key AS id, original_index, text, array_to_string(types, ',') AS types FROM corpus WHERE key % 3 = 1")
def _(spark, d):
    own = corpus_rows(spark, d).withColumn("locale", F.expr("case key % 3 when 0 then 'intl' when 1 then 'us' end"))
    own.select("text", "spans", "original_index", "locale").write.parquet(path := shared_dir(spark) + "/spans")
    return corpora.read_exact(spark, path, "spans", ["us", "US"]).select("id", "original_index", "text", F.array_join("types", ",").alias("types"))


@query("a1_entities_corpus", f"WITH {CORPUS_SQL} SELECT 'c_' || key AS id, original_index, text, array_to_string(flatten(list_transform(types, lambda t: [t, 'PERSON'])), ',') AS types FROM corpus")
def _(spark, d):
    corpus_rows(spark, d).select("text", "entities", "original_index").write.parquet(path := shared_dir(spark) + "/entities")
    return corpora.read_corpus(spark, path, "entities").select("id", "original_index", "text", F.array_join("types", ",").alias("types"))


@query("d14_top_types", f"WITH {CORPUS_SQL}, c AS (SELECT source, type, count(*) AS n FROM (SELECT source, unnest(types) AS type FROM corpus) GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, type) AS place FROM c QUALIFY place <= 10")
def _(spark, d):
    return corpora.summary(typed(spark, d))


# ---- JSON arrays ----


@query("a2_json_array", f"WITH {CARDS_SQL} SELECT 's' || key AS id, text, len(gold) AS n, (list_sum(list_transform(gold, lambda g: g.stop - g.start)))::BIGINT AS chars FROM cards")
def _(spark, d):
    path = shared_dir(spark) + "/arrays"
    gold = F.transform("gold", lambda s: F.struct(s["type"].alias("type"), s["text"].alias("text"), s["start"].alias("start"), s["stop"].alias("end")))
    own = cards(spark, d).select(F.concat(F.lit("s"), F.col("key")).alias("id"), "text", "source", F.to_json(gold).alias("ground_truth"))
    json_array.write_arrays(own, path)
    back = results.with_spans(json_array.read_array(spark, path, results.SAMPLES), "ground_truth")
    return back.select("id", "text", F.size("ground_truth").cast("long").alias("n"), F.aggregate("ground_truth", F.lit(0), lambda n, g: n + g["stop"] - g["start"]).cast("long").alias("chars"))


@query("a7_benchmark_index", f"WITH {CARDS_SQL} SELECT CASE WHEN key % 4 = 3 THEN 'known by place' WHEN key % 4 = 2 THEN 'other' || key ELSE 'b' || key END AS key, count(*) AS n, sum(len(gold))::BIGINT AS gold FROM cards GROUP BY 1")
def _(spark, d):
    """Rows are known by id or sample_id; every fourth has neither and is known by its position."""
    path = shared_dir(spark) + "/benchmark.json"
    k = F.col("key")
    types = F.to_json(F.transform("gold", lambda g: F.struct(g["type"].alias("type"))))
    own = cards(spark, d).select(F.when(k % 4 < 2, F.concat(F.lit("b"), k)).alias("id"), F.when(k % 4 == 2, F.concat(F.lit("other"), k)).alias("sample_id"), types.alias("ground_truth"))
    json_array.write_arrays(own, path)
    bench = loaders.read_benchmark(spark, path)
    name = F.when(F.col("key").rlike("^[0-9]+$"), "known by place").otherwise(F.col("key"))
    return bench.groupBy(name.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(loaders.as_spans(F.col("ground_truth")))).alias("gold"))


# ---- loaders ----

_BENCH = """bench AS (SELECT 's' || key AS id, len(gold) AS n, key % 5 AS kind FROM cards WHERE key % 6 <> 0)"""


def _published(spark, d, folder: str) -> None:
    own = records(spark, d).filter("condition in ('zero_shot', 'with_tools')")
    results.write_run(own, f"{folder}/splits", "main", "v1")
    k = F.col("key")
    names = F.to_json(F.transform("gold", lambda g: g["type"]))
    objects = F.to_json(F.transform("gold", lambda g: F.struct(g["type"].alias("type"))))
    canonical = F.when(k % 5 == 0, names).when(k % 5 == 1, objects).when(k % 5 == 2, "[]").when(k % 5 == 3, "not a list")
    bench = cards(spark, d).filter("key % 6 <> 0").select(F.concat(F.lit("s"), k).alias("id"), "source", k.alias("original_index"), objects.alias("ground_truth"), canonical.alias("canonical"))
    bench.write.parquet(f"{folder}/benchmark")


def _loaded(run):
    n = lambda c: F.coalesce(F.sum(F.greatest(F.size(c), F.lit(0))), F.lit(0))
    return run.groupBy("place", "model", "condition").agg(F.count(F.lit(1)).alias("n"), n("preds").alias("preds"), n("gold").alias("gold"), F.count_if(F.size("canonical") > 0).alias("named"), F.count_if("tool").alias("tools"), F.count("scores").alias("scored"), F.sum("turns").alias("turns"))


@query(
    "a5_analysis_of_split",
    f"""WITH {RECORDS_SQL}, {_BENCH} SELECT 'published' AS place, model, condition, count(*) AS n, sum(len(preds))::BIGINT AS preds, coalesce(sum(b.n), 0)::BIGINT AS gold, count(*) FILTER (b.kind = 0) AS named,
  count(*) FILTER (tool) AS tools, 0::BIGINT AS scored, sum(turns)::BIGINT AS turns FROM records r LEFT JOIN bench b ON b.id = r.sample_id WHERE condition IN ('zero_shot', 'with_tools') GROUP BY model, condition""",
)
def _(spark, d):
    folder = shared_dir(spark)
    _published(spark, d, folder)
    return _loaded(loaders.load_analysis(spark, "main", "v1", f"{folder}/splits", f"{folder}/benchmark", f"{folder}/none.json"))


def _local(spark, d, path: str) -> None:
    """Results as a JSON array: lists as values or, for every second key, as text; scores for every third."""
    item = lambda c: F.to_json(F.transform(c, lambda s: F.struct(s["type"].alias("type"), s["text"].alias("text"), s["start"].alias("start"), s["stop"].alias("end"))))
    listed = lambda c: F.when(F.col("key") % 2 == 0, F.to_json(F.struct(item(c).alias("x")))).otherwise(F.concat(F.lit('{"x":'), item(c), F.lit("}")))
    own = records(spark, d).filter("condition in ('zero_shot', 'with_tools')")
    scores = F.when(F.col("key") % 3 == 0, F.parse_json(F.lit('{"f1": 0.5}')))
    own = own.select(
        "sample_id", "source", "model", "condition", F.try_variant_get(F.parse_json(listed("preds")), "$.x", "variant").alias("predictions"), F.try_variant_get(F.parse_json(listed("gold")), "$.x", "variant").alias("ground_truth"),
        scores.alias("scores"), "error", F.col("tool").alias("tool_executed"), F.col("skill").alias("skill_viewed"), F.col("elapsed").alias("elapsed_seconds"), F.col("turns").alias("conversation_turns"),
    )
    json_array.write_arrays(own, path)


def _local_sql(place: str) -> str:
    return f"""WITH {RECORDS_SQL} SELECT '{place}' AS place, model, condition, count(*) AS n, sum(len(preds))::BIGINT AS preds, sum(len(gold))::BIGINT AS gold, 0::BIGINT AS named, count(*) FILTER (tool) AS tools,
  count(*) FILTER (key % 3 = 0) AS scored, sum(turns)::BIGINT AS turns FROM records WHERE condition IN ('zero_shot', 'with_tools') GROUP BY model, condition"""


@query("a5_analysis_of_local", _local_sql("local"))
def _(spark, d):
    folder = shared_dir(spark)
    _local(spark, d, f"{folder}/experiment_results.json")
    return _loaded(loaders.load_analysis(spark, "main", "v1", f"{folder}/splits", f"{folder}/benchmark", f"{folder}/experiment_results.json"))


@query("a5_analysis_of_legacy", _local_sql("legacy"))
def _(spark, d):
    folder = shared_dir(spark)
    _local(spark, d, f"{folder}/old/main")
    return _loaded(loaders.load_analysis(spark, "main", "v1", f"{folder}/splits", f"{folder}/benchmark", f"{folder}/none.json", f"{folder}/old"))


@query(
    "a6_existing_results",
    f"""WITH {RECORDS_SQL} SELECT 'published' AS place, model, condition, count(*) AS n, sum(len(preds))::BIGINT AS preds, 0::BIGINT AS gold, 0::BIGINT AS named, count(*) FILTER (tool) AS tools, 0::BIGINT AS scored, sum(turns)::BIGINT AS turns
  FROM records WHERE condition IN ('zero_shot', 'with_tools') GROUP BY model, condition""",
)
def _(spark, d):
    folder = shared_dir(spark)
    _published(spark, d, folder)
    return _loaded(loaders.existing_results(spark, "main", "v1", f"{folder}/none.json", f"{folder}/splits"))


# ---- sinks ----


@query(
    "a13_transactional_sink",
    f"""WITH {RECORDS_SQL} SELECT 'run' || m.x AS run_id, m.x AS run_type, model, count(*) AS n, sum(len(preds))::BIGINT AS preds FROM records, (VALUES ('main', 'zero_shot'), ('rr', 'cot')) m(x, c) WHERE condition = m.c GROUP BY ALL""",
)
def _(spark, d):
    """Two runs, one of them written twice: each run is there once."""
    path = shared_dir(spark) + "/runs"
    own = records(spark, d)
    for kind, condition in (("main", "zero_shot"), ("rr", "cot"), ("main", "zero_shot")):
        run_sink.write_once(results.published(own.filter(F.col("condition") == condition)), path, f"run{kind}", kind)
    back = results.with_spans(run_sink.read_runs(spark, path, results.RUN), "predictions")
    return back.groupBy("run_id", "run_type", "model").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("predictions")).alias("preds"))


@query("a17_detector_run", f"WITH {CARDS_SQL} SELECT 's' || key AS sample_id, source, 'detectors' AS model, 'EMAIL_ADDRESS,PHONE_NUMBER' AS types, gold0[2].start AS start, true AS tool_executed, 0.5::DOUBLE AS recall FROM cards")
def _(spark, d):
    path = shared_dir(spark) + "/runs"
    own = cards(spark, d).withColumn("id", F.concat(F.lit("s"), F.col("key")))
    scored = match.scored(runner.detector_run(own), (("span", "full", "f1+"),)).withColumns({"p": F.col("p_f1"), "r": F.col("r_f1")})
    run_sink.write_once(results.published(runner.detector_records(scored)), path, "detectors", "detector")
    back = results.with_spans(run_sink.read_runs(spark, path, results.RUN), "predictions")
    recall = F.round(F.get_json_object("scores", "$.recall").cast("double"), 6)
    return back.select("sample_id", "source", "model", F.array_join(F.transform("predictions", lambda p: p["type"]), ",").alias("types"), F.get("predictions", F.lit(0))["start"].alias("start"), "tool_executed", recall.alias("recall"))


# ---- configuration ----

LAYERS = {
    "harness": {
        "common": {"models": ["m0", "m1"], "batch": 12, "templates": {"zero_shot": "{text}", "cot": "Think. {text}"}, "unknown": 1},
        "cpu": {"batch": 5, "templates": {"cot": "Slowly. {text}"}},
        "cuda": {"models": ["m9"]},
    }
}


@query(
    "a11_layered_run",
    f"""WITH {CARDS_SQL} SELECT m.m AS model, c.c AS condition, count(*) AS n, count(*) FILTER (length(c.lead || text) % 10 = 0) AS errors FROM cards, (VALUES ('m0'), ('m1')) m(m), (VALUES ('zero_shot', ''), ('cot', 'Slowly. ')) c(c, lead) GROUP BY m.m, c.c""",
)
def _(spark, d):
    own = config.known(config.layered(LAYERS, "cpu"))
    out = grid.Grid(own, obedient, shared_dir(spark) + "/grid").run(cards(spark, d).drop("gold0"))
    return out.groupBy("model", "condition").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("error") != "").alias("errors"))


# ---- gold side of the date labels ----


@query("d12_gold_dates", f"WITH {RECORDS_SQL}, g AS (SELECT key, any_value(list_transform(gold, lambda s: CASE WHEN key % 4 = 0 AND s.type = 'LOCATION' THEN 'date' WHEN key % 4 = 1 AND s.type = 'LOCATION' THEN 'date-time' ELSE s.type END)) AS ts FROM records GROUP BY key), r AS (SELECT count(*) AS n_results, sum(len(preds))::BIGINT AS n_spans FROM records WHERE condition IN ('with_tools', 'with_skills')) SELECT sum(len(list_filter(ts, lambda t: t = 'date')))::BIGINT AS gold_dates, sum(len(list_filter(ts, lambda t: t = 'date-time')))::BIGINT AS gold_date_times, any_value(n_results) AS n_results, any_value(n_spans) AS n_spans, round(any_value(n_spans) / any_value(n_results), 6) AS spans_a_result FROM g, r")
def _(spark, d):
    from spanmill.operators import analytics

    relabel = F.transform("gold", lambda s: F.struct(F.when((F.col("key") % 4 == 0) & (s["type"] == "LOCATION"), "date").when((F.col("key") % 4 == 1) & (s["type"] == "LOCATION"), "date-time").otherwise(s["type"]).alias("type"), s["text"].alias("text"), s["start"].alias("start"), s["stop"].alias("stop")))
    return analytics.date_labels(records(spark, d).withColumn("gold", relabel))


@query("a4_run_with_fallback", f"WITH {RECORDS_SQL} SELECT model, count(*) AS n, sum(len(preds))::BIGINT AS preds FROM records WHERE condition = 'cot' GROUP BY model")
def _(spark, d):
    """The first place is missing, the second holds the run; a third is not looked at."""
    folder = shared_dir(spark)
    results.write_run(records(spark, d).filter("condition = 'cot'"), f"{folder}/runs", "main", "v1")
    found = results.read_first(spark, [f"{folder}/none.json", f"{folder}/runs/run_type=main/prompt_version=v1", f"{folder}/more"], results.RUN)
    return results.with_spans(found, "predictions").groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("predictions")).alias("preds"))


@query("b17_redacted_content", f"WITH {RECORDS_SQL} SELECT key, model, condition, array_to_string(list_transform(preds, lambda p: p.type || ':' || p.start || ':' || p.stop || ':' || '[REDACTED]'), ' ') AS hidden FROM records")
def _(spark, d):
    shown = F.transform(spans.redacted(F.col("preds")), lambda p: F.concat_ws(":", p["type"], p["start"], p["stop"], p["text"]))
    return records(spark, d).select("key", "model", "condition", F.array_join(shown, " ").alias("hidden"))



# ---- samples ----


def _hydrated(spark, d, n=None):
    folder = shared_dir(spark)
    own = corpus_rows(spark, d).withColumn("text", F.when(F.col("key") % 9 != 0, F.col("text")))
    item = "transform(masks, m -> struct(m.label as label, 'x' as value, 0L as start, 1L as end))"
    own.filter("source = 'alpha'").select(F.col("text").alias("source_text"), F.expr(item).alias("privacy_mask"), "original_index", F.lit("English").alias("language")).write.parquet(f"{folder}/alpha")
    own.filter("source = 'beta'").select("text", "spans", "original_index", F.lit("us").alias("locale")).write.parquet(f"{folder}/beta")
    own.filter("source = 'gamma'").select("text", "entities", "original_index").write.parquet(f"{folder}/gamma")
    results.write_benchmark(corpus.compiled(typed(spark, d)), f"{folder}/benchmark")
    bench = spark.read.schema(results.BENCHMARK).parquet(f"{folder}/benchmark")
    places = {s: (layout, f"{folder}/{s}") for s, layout in (("alpha", "masks"), ("beta", "spans"), ("gamma", "entities"))}
    json_array.write_arrays(samples.build(spark, bench, places, n), f"{folder}/samples")
    return json_array.read_array(spark, f"{folder}/samples", results.SAMPLES)


_KEPT = f"kept AS (SELECT * FROM corpus WHERE key % 9 <> 0 AND len(types) > 0 AND len(list_filter({STRICT_SQL}, lambda t: t IS NULL)) = 0)"


@query("a16_hydrated_samples", f"WITH {CORPUS_SQL}, {_KEPT} SELECT 'a_' || key AS id, source, text, len(types) AS n_gold FROM kept")
def _(spark, d):
    return _hydrated(spark, d).select("id", "source", "text", F.size(loaders.as_spans(F.col("ground_truth"))).cast("long").alias("n_gold"))


@query("a16_thinned_samples", f"WITH {CORPUS_SQL}, {_KEPT}, named AS (SELECT *, 'a_' || key AS id FROM kept), {sample_sql(50, 'named', f'source || {BIN}', 'id', 'id, source')}")
def _(spark, d):
    return _hydrated(spark, d, 50).select("id", "source")
