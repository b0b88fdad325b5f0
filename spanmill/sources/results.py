"""Readers and writers of samples, benchmarks and runs, with fixed schemas."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from spanmill.functions import spans, text

SAMPLES = "id string, text string, source string, ground_truth string"
BENCHMARK = "id string, source string, original_index long, ground_truth string, canonical string"
#: The 13 columns of a published run.
RUN = (
    "sample_id string, source string, model string, condition string, predictions string, ground_truth string, scores string, raw_response string, "
    "error string, tool_executed boolean, skill_viewed boolean, conversation_turns long, elapsed_seconds double"
)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of samples; gold as spans with integer offsets."""
    return with_spans(spark.read.schema(SAMPLES).json(path, multiLine=True), "ground_truth")


def with_spans(df: DataFrame, column: str) -> DataFrame:
    """A JSON text column as array<struct<type,text,start,stop>>; items without a type key are dropped."""
    read = text.read_spans(text.with_type(text.json_list(F.col(column))))
    return df.withColumn(column, F.coalesce(read, F.array().cast(spans.SPAN.join(("array<", ">")))))


def read_run(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN + ", run_type string, prompt_version string").parquet(path)


def read_first(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The first of several places that can be read (JSON or Parquet); an empty table if there is none."""
    for path in paths:
        try:
            return spark.read.schema(schema).json(path, multiLine=True) if path.endswith(".json") else spark.read.schema(schema).parquet(path)
        except AnalysisException:
            continue
    return spark.createDataFrame([], schema)


def read_labels(path: str) -> dict[str, str | None]:
    """A label map; empty where there is none."""
    try:
        return json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return {}


def read_prompts(folder: str, conditions: list[str]) -> dict[str, str]:
    """One template a condition; a missing file is an error."""
    return {c: (Path(folder) / f"{c}.txt").read_text() for c in conditions}


def list_skills(folder: str) -> list[str]:
    return sorted(p.parent.name for p in Path(folder).glob("*/SKILL.md"))


def read_skill(folder: str, name: str, fallback: str = "") -> str:
    path = Path(folder) / name / "SKILL.md"
    return path.read_text() if path.is_file() else fallback


def _text_of(span: str, stop: str):
    return lambda s: F.struct(s["type"].alias("type"), s["text"].alias("text"), s["start"].alias(span), s["stop"].alias(stop))


def published(records: DataFrame) -> DataFrame:
    """records in the 13 columns: lists and scores as JSON text, "[]" and "" for nulls, span texts hidden."""
    hidden = F.transform(spans.redacted(F.col("preds")), _text_of("start", "end"))
    gold = F.transform(spans.redacted(F.col("gold")), _text_of("start", "end"))
    scores = F.to_json(F.struct(F.round("p", 4).alias("precision"), F.round("r", 4).alias("recall"), F.round("f1", 4).alias("f1"))) if "f1" in records.columns else F.lit("[]")
    return records.select(
        F.col("sample_id").cast("string").alias("sample_id"),
        "source",
        "model",
        "condition",
        F.coalesce(F.to_json(hidden), F.lit("[]")).alias("predictions"),
        F.coalesce(F.to_json(gold), F.lit("[]")).alias("ground_truth"),
        F.coalesce(scores, F.lit("[]")).alias("scores"),
        F.lit(None).cast("string").alias("raw_response"),
        F.coalesce("error", F.lit("")).alias("error"),
        F.col("tool").alias("tool_executed"),
        F.col("skill").alias("skill_viewed"),
        F.col("turns").cast("long").alias("conversation_turns"),
        F.col("elapsed").cast("double").alias("elapsed_seconds"),
    )


def write_run(records: DataFrame, path: str, run_type: str, version: str, mode: str = "overwrite") -> None:
    """A run, in its partition; overwriting one partition leaves the others."""
    out = published(records).withColumns({"run_type": F.lit(run_type), "prompt_version": F.lit(version)})
    out.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("run_type", "prompt_version").parquet(path)


def write_benchmark(compiled: DataFrame, path: str) -> None:
    """The benchmark without texts, lists as JSON. Fails where a row is there twice."""
    from spanmill.operators.corpus import unique

    if not unique(compiled, "source", "original_index").head()["is_unique"]:
        raise ValueError("a (source, original_index) occurs twice")
    types = F.to_json(F.transform("ground_truth", lambda t: F.struct(t.alias("type"))))
    compiled.withColumns({"ground_truth": types, "canonical": F.to_json("canonical")}).write.mode("overwrite").parquet(path)


def write_samples(samples: DataFrame, path: str) -> None:
    """Samples as JSON lines: id, text, source and the gold as JSON text."""
    gold = F.to_json(F.transform("gold", _text_of("start", "end")))
    samples.select("id", "text", "source", gold.alias("ground_truth")).write.mode("overwrite").json(path)
