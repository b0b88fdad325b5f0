"""Running a plugged-in model over a grid of samples, models and conditions."""

from __future__ import annotations

import argparse
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanmill.functions import spans, text
from spanmill.operators import corpus, match
from spanmill.sources.paths import dealt

#: Rows that a worker takes up at a time.
PIECE = 1000
SINGLE_TURN = ("zero_shot", "with_docs", "few_shot", "cot")


class Tools:
    """Tools by name. An unknown name, or a tool that raises, gives {"error": ...}."""

    def __init__(self, **tools: Callable[..., dict]):
        self.tools = dict(tools)

    def run(self, name: str, **arguments) -> dict:
        if name not in self.tools:
            return {"error": f"no tool named {name}"}
        try:
            return self.tools[name](**arguments)
        except Exception as e:  # a tool's failure is a result, not the run's end
            return {"error": str(e), "detections": []}


def prompts(samples: DataFrame, templates: dict[str, str], models: list[str], body: str = "text") -> DataFrame:
    """samples x models x conditions with their prompts: {text} is replaced literally. No join is needed."""
    grid = [F.struct(F.lit(m).alias("model"), F.lit(c).alias("condition"), F.lit(t).alias("template")) for m in models for c, t in templates.items()]
    wide = samples.withColumn("__g", F.explode(F.array(*grid)))
    return wide.withColumns({"model": F.col("__g.model"), "condition": F.col("__g.condition"), "prompt": F.replace(F.col("__g.template"), F.lit("{text}"), F.coalesce(body, F.lit("")))}).drop("__g")


class Reply(str):
    """A response that says how many seconds it took."""

    seconds: float | None = None

    def __new__(cls, text: str, seconds: float | None = None):
        out = super().__new__(cls, text)
        out.seconds = seconds
        return out


def generate(rows: DataFrame, make: Callable[[str], Callable[[list], list]], batch: int = 12) -> DataFrame:
    """rows with raw_response, error and elapsed: make(model) gives a function from prompts to responses.

    Models are made once a partition. A batch that raises is tried again one by one; a null response is an error. A function with a true
    attribute takes_rows gets whole rows (as dictionaries) instead of prompts. Replies that tell their seconds are believed; else
    the time of a batch is shared equally.
    """
    added = [T.StructField("raw_response", T.StringType()), T.StructField("error", T.StringType()), T.StructField("elapsed", T.DoubleType())]
    schema = T.StructType([*rows.schema.fields, *added])

    def replies(model: Callable[[list], list], asked: list) -> Iterator[tuple]:
        for at in range(0, len(asked), batch):
            some = asked[at : at + batch]
            began = time.perf_counter()
            try:
                got = [(r, "" if r is not None else "no response") for r in model(some)]
                if len(got) != len(some):
                    raise ValueError(f"{len(got)} responses to {len(some)} prompts")
            except Exception:
                got = [_alone(model, p) for p in some]
            share = (time.perf_counter() - began) / len(some)
            for r, e in got:
                own = getattr(r, "seconds", None)
                yield r if r is None else str(r), e, float(share if own is None else own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict = {}
        for whole in batches:
            for at in range(0, whole.num_rows, PIECE):
                b = whole.slice(at, PIECE)
                places: dict = {}
                for i, m in enumerate(b.column(b.schema.names.index("model")).to_pylist()):
                    places.setdefault(m, []).append(i)
                for model, own in places.items():
                    if model not in made:
                        made.clear()  # one model at a time
                        made[model] = make(model)
                    part = b if len(places) == 1 else b.take(pa.array(own))
                    asked = part if getattr(made[model], "takes_rows", False) else part.column(part.schema.names.index("prompt"))
                    told = zip(*replies(made[model], asked.to_pylist()), strict=True)
                    new = [pa.array(x, t) for x, t in zip(told, (pa.string(), pa.string(), pa.float64()), strict=True)]
                    yield pa.RecordBatch.from_arrays([*part.columns, *new], names=schema.names)

    return rows.mapInArrow(run, schema)


def _alone(model: Callable[[list], list], asked) -> tuple:
    try:
        r = model([asked])[0]
        return r, "" if r is not None else "no response"
    except Exception as e:
        return None, str(e) or type(e).__name__


def hooked(rows: DataFrame, make: Callable[[str], Callable[[list], list]], hook: Callable[..., dict]) -> DataFrame:
    """rows (model, condition, prompt, ...) with raw_response, error, elapsed, tool, skill and turns from a callable a sample.

    hook(model function, sample, prompt, flags) gives a dictionary with predictions or raw_response, error, tool_executed, skill_viewed,
    conversation_turns; flags tell with_skills, with_docs and with_tools. What it raises is the row's error.
    """
    kept = [f for f in rows.schema.fields if f.name not in HOOKED]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "raw_response string, error string, elapsed double, tool boolean, skill boolean, turns long"])

    def one(model: Callable[[list], list], row: dict) -> dict:
        try:
            return hook(model, row, row["prompt"], condition_flags(row["condition"]))
        except Exception as e:
            return {"error": str(e) or type(e).__name__, "conversation_turns": 0}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict = {}
        for frame in frames:
            for model, part in frame.groupby("model", sort=False):
                if model not in made:
                    made.clear()
                    made[model] = make(model)
                got, spent = [], []
                for row in part.to_dict("records"):
                    began = time.perf_counter()
                    got.append(one(made[model], row))
                    spent.append(float(got[-1].get("elapsed_seconds", time.perf_counter() - began)))
                raw = [json.dumps(g["predictions"]) if g.get("predictions") is not None else g.get("raw_response") for g in got]
                yield part[[f.name for f in kept]].assign(
                    raw_response=raw, error=[g.get("error") or "" for g in got], elapsed=spent,
                    tool=[bool(g.get("tool_executed")) for g in got], skill=[bool(g.get("skill_viewed")) for g in got], turns=[int(g.get("conversation_turns", 1)) for g in got],
                )

    return rows.mapInPandas(run, schema)


HOOKED = ("raw_response", "error", "elapsed", "tool", "skill", "turns")


def condition_flags(condition: str) -> dict[str, bool]:
    """What a condition offers; the baselines offer nothing."""
    return {"with_skills": condition == "with_skills", "with_docs": condition in ("with_docs", "with_skills"), "with_tools": condition in ("with_tools", "with_skills")}


def answered(rows: DataFrame) -> DataFrame:
    """rows with preds read from raw_response."""
    return rows.withColumn("preds", text.read_spans(text.answer(F.coalesce("raw_response", F.lit("")))))


@dataclass(frozen=True)
class Config:
    models: list[str] = field(default_factory=list)
    templates: dict[str, str] = field(default_factory=dict)
    batch: int = 12
    mode: str = "span"
    how: str = "full"

    @classmethod
    def read(cls, path: str) -> Config:
        with open(path) as f:
            held = json.load(f)
        return cls(**{k: v for k, v in held.items() if k in cls.__dataclass_fields__})


class Runner:
    """run(samples) gives scored records; with `saved`, groups that are run again replace the saved ones."""

    def __init__(self, config: Config, make: Callable[[str], Callable[[list], list]]):
        self.config, self.make = config, make

    def run(self, samples: DataFrame, saved: DataFrame | None = None) -> DataFrame:
        c = self.config
        out = answered(generate(prompts(dealt(samples), c.templates, c.models), self.make, c.batch))
        scored = match.scored(out, ((c.mode, c.how, "f1+"),))
        return scored if saved is None else corpus.merged(saved, scored)

    __call__ = run


def detector_run(samples: DataFrame, body: str = "text") -> DataFrame:
    """samples with the regular-expression detectors' spans as preds."""
    found = F.transform(text.detect(F.col(body)), lambda s: F.struct(s["type"].alias("type"), s["text"].alias("text"), s["start"].alias("start"), s["stop"].alias("stop")))
    return samples.withColumn("preds", found)


def detector_records(scored: DataFrame) -> DataFrame:
    """A detector run (id, source, preds, gold, f1) with the columns of a run's records."""
    told = {"sample_id": F.col("id").cast("string"), "model": F.lit("detectors"), "condition": F.lit("standalone"), "error": F.lit(""), "tool": F.lit(True), "skill": F.lit(False), "turns": F.lit(0).cast("long"), "elapsed": F.lit(0.0)}
    return scored.withColumns(told)


def main(argv: list[str] | None = None) -> None:
    """Scores samples by the detectors, or runs a grid of models over them.

    Detectors: --samples PATH --out PATH [--predictions]. Grid: --config PATH --make MODULE:FUNCTION --samples PATH --out PATH
    [--conditions A,B] [--models A,B] [--n N] [--again]; what the log under --out names is not run again, unless --again is given.
    """
    import importlib

    from spanmill.sources import results

    p = argparse.ArgumentParser(description=main.__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--samples", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--predictions", action="store_true", help="write the detectors' spans as a run too")
    p.add_argument("--config", help="a file, or a folder with layered configuration")
    p.add_argument("--make", help="MODULE:FUNCTION that makes a model from its name")
    p.add_argument("--conditions", help="those of the configuration to run")
    p.add_argument("--models", help="those of the configuration to run")
    p.add_argument("--n", type=int, help="samples, by a fixed shuffle")
    p.add_argument("--again", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    read = results.read_samples(spark, a.samples).withColumnRenamed("ground_truth", "gold")
    if a.n is not None:
        read = corpus.capped(read.withColumn("__o", corpus.order_of("id", 42)), a.n, ["__o", "id"]).drop("__o")
    if a.config is None:
        found = detector_run(read)
        scored = match.scored(found, (("span", "full", "f1+"),))
        scored.select("id", "source", "n_pred", "n_gold", "f1").write.mode("overwrite").parquet(a.out)
        if a.predictions:
            results.write_run(detector_records(scored.withColumns({"p": F.col("p_f1"), "r": F.col("r_f1")})), a.out.rstrip("/") + "_run", "detector", "v1")
        return
    from pathlib import Path

    from spanmill.operators import config, grid

    held = config.from_folder(a.config) if Path(a.config).is_dir() else config.known(config.read(a.config))
    own = set(a.conditions.split(",")) if a.conditions else set(held.templates)
    if odd := own - set(held.templates):
        p.error(f"no template for {', '.join(sorted(odd))}")
    models = [m for m in held.models if not a.models or m in a.models.split(",")]
    if not a.make or ":" not in a.make:
        p.error("--make MODULE:FUNCTION is needed with --config")
    module, name = a.make.split(":", 1)
    make = getattr(importlib.import_module(module), name)
    run = grid.Grid(Config(models, {c: t for c, t in held.templates.items() if c in own}, held.batch, held.mode, held.how), make, a.out)
    run.run(read, resume=not a.again)
    run.summary(spark).orderBy("model", "condition").show(1000, truncate=False)


if __name__ == "__main__":
    main()
