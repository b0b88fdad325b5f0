"""Runs from wherever they are: published splits, local results, legacy files. Places are tried in order and only as far as needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from spanmill.functions import spans, text
from spanmill.sources import results
from spanmill.sources.json_array import by_id, read_array

#: Columns of a loaded run, whatever place it comes from.
LOADED = ["sample_id", "source", "model", "condition", "preds", "gold", "canonical", "scores", "error", "tool", "skill", "elapsed", "turns", "place"]
#: A record of local results; lists may be JSON values or JSON text.
LOCAL = (
    "sample_id string, source string, model string, condition string, predictions variant, ground_truth variant, scores variant, error string, "
    "tool_executed boolean, skill_viewed boolean, elapsed_seconds double, conversation_turns long"
)
#: A row of the benchmark's file; the second name of the canonical list is that of published files.
BENCHMARK_FILE = "id string, sample_id string, source string, original_index long, ground_truth variant, canonical variant, pii_codex_ground_truth variant"


def as_text(v: Column) -> Column:
    """A JSON value as text; text stays as it is."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))


def as_spans(json_text: Column) -> Column:
    """The objects of a JSON list as spans; an empty list where it is none."""
    objects = F.filter(text.json_list(json_text), lambda v: F.schema_of_variant(v).startswith("OBJECT"))
    return F.coalesce(text.read_spans(objects), F.array().cast(f"array<{spans.SPAN}>"))


def canonical_types(json_text: Column) -> Column:
    """The names of a canonical list of names; null where it is a list of objects, empty or none."""
    items = text.json_list(json_text)
    names = F.transform(items, lambda v: F.try_variant_get(v, "$", "string"))
    return F.when(F.schema_of_variant(F.get(items, F.lit(0))) == "STRING", names)


def gold_of(canonical: Column, ground_truth: Column) -> Column:
    """Gold spans: the canonical list if it has names (types alone) or objects, else the benchmark's own."""
    bare = F.transform(canonical_types(canonical), lambda t: F.struct(t.alias("type"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("stop")))
    objects = as_spans(canonical)
    return F.coalesce(bare.cast(f"array<{spans.SPAN}>"), F.when(F.size(objects) > 0, objects), as_spans(ground_truth))


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """key, ground_truth and canonical (JSON text) of a benchmark: a JSON array, bare or under "samples", or Parquet; rows are known by
    id or sample_id, else by position."""
    if path.endswith(".json"):
        rows = by_id(read_array(spark, path, BENCHMARK_FILE), "id", "sample_id")
        return rows.select("key", as_text(F.col("ground_truth")).alias("ground_truth"), as_text(F.coalesce("pii_codex_ground_truth", "canonical")).alias("canonical"))
    return spark.read.schema(results.BENCHMARK).parquet(path).select(F.col("id").alias("key"), "ground_truth", "canonical")


def _split(spark: SparkSession, path: str, run_type: str, version: str) -> DataFrame:
    return spark.read.schema(results.RUN).parquet(f"{path}/run_type={run_type}/prompt_version={version}")


def published(spark: SparkSession, path: str, run_type: str, version: str, benchmark: DataFrame | None) -> DataFrame:
    """A published split; gold comes from the benchmark by a join, and is null without one."""
    run = _split(spark, path, run_type, version)
    if benchmark is None:
        run = run.withColumns({"gold": F.lit(None).cast(f"array<{spans.SPAN}>"), "types": F.lit(None).cast("array<string>")})
    else:
        known = benchmark.select(F.col("key").alias("__key"), F.col("canonical").alias("__canonical"), F.col("ground_truth").alias("__truth"))
        run = run.join(known, F.col("sample_id") == F.col("__key"), "left").withColumns({"gold": gold_of(F.col("__canonical"), F.col("__truth")), "types": canonical_types(F.col("__canonical"))})
    scores = F.when(F.schema_of_variant(F.try_parse_json("scores")).startswith("OBJECT"), F.col("scores"))
    return run.select(
        "sample_id", F.coalesce("source", F.lit("")).alias("source"), "model", "condition", as_spans(F.col("predictions")).alias("preds"), "gold", F.col("types").alias("canonical"), scores.alias("scores"), "error",
        F.coalesce("tool_executed", F.lit(False)).alias("tool"), F.coalesce("skill_viewed", F.lit(False)).alias("skill"), F.col("elapsed_seconds").alias("elapsed"), F.col("conversation_turns").alias("turns"), F.lit("published").alias("place"),
    )


def local(spark: SparkSession, path: str, place: str = "local") -> DataFrame:
    """Results in a JSON array, with gold of their own."""
    run = read_array(spark, path, LOCAL)
    return run.select(
        "sample_id", F.coalesce("source", F.lit("")).alias("source"), "model", "condition", as_spans(as_text(F.col("predictions"))).alias("preds"), as_spans(as_text(F.col("ground_truth"))).alias("gold"),
        F.lit(None).cast("array<string>").alias("canonical"), F.when(F.schema_of_variant("scores").startswith("OBJECT"), F.to_json("scores")).alias("scores"), "error",
        F.coalesce("tool_executed", F.lit(False)).alias("tool"), F.coalesce("skill_viewed", F.lit(False)).alias("skill"), F.col("elapsed_seconds").alias("elapsed"), F.col("conversation_turns").alias("turns"), F.lit(place).alias("place"),
    )


def _first(tries: list) -> DataFrame | None:
    for read in tries:
        try:
            out = read()
        except AnalysisException:  # nothing is there
            continue
        return out
    return None


def load_analysis(spark: SparkSession, run_type: str, version: str, splits: str | None = None, benchmark: str | None = None, results_path: str | None = None, legacy: str | None = None) -> DataFrame:
    """The run of the first place that has one: the published split with the benchmark's gold, local results, a legacy file.

    The split counts only if the benchmark can be read too. FileNotFoundError if there is none.
    """
    tries = []
    if splits and benchmark:
        tries.append(lambda: published(spark, splits, run_type, version, read_benchmark(spark, benchmark)))
    if results_path:
        tries.append(lambda: local(spark, results_path))
    if legacy:
        tries.append(lambda: local(spark, f"{legacy}/{run_type}", "legacy"))
    out = _first(tries)
    if out is None:
        raise FileNotFoundError(f"no results of {run_type} {version}")
    return out


def existing_results(spark: SparkSession, run_type: str, version: str, results_path: str | None = None, splits: str | None = None) -> DataFrame:
    """What a new run is merged with: local results, else the published split, whose gold is null; empty if there is neither."""
    tries = [lambda: local(spark, results_path)] if results_path else []
    if splits:
        tries.append(lambda: published(spark, splits, run_type, version, None))
    out = _first(tries)
    if out is None:
        kinds = {"preds": f"array<{spans.SPAN}>", "gold": f"array<{spans.SPAN}>", "canonical": "array<string>", "tool": "boolean", "skill": "boolean", "elapsed": "double", "turns": "long"}
        out = spark.createDataFrame([], ", ".join(f"{c} {kinds.get(c, 'string')}" for c in LOADED))
    return out


def missing_gold(run: DataFrame) -> DataFrame:
    """Rows without gold, for labelling by hand."""
    return run.filter(F.coalesce(F.size("gold"), F.lit(0)) <= 0)
