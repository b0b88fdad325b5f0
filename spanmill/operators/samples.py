"""Building a samples file: a benchmark without texts, joined to its corpora, thinned if wanted, written as JSON arrays."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.functions import spans
from spanmill.operators import corpus
from spanmill.sources import corpora, json_array, results


def texts_of(spark: SparkSession, places: dict[str, tuple[str, str]]) -> DataFrame:
    """source, original_index and text of all corpora: places gives each source's layout and path."""
    out = None
    for source, (layout, path) in sorted(places.items()):
        own = corpora.read_corpus(spark, path, layout, source=source).select("source", "original_index", "text")
        out = own if out is None else out.unionByName(own)
    return spark.createDataFrame([], "source string, original_index long, text string") if out is None else out


def build(spark: SparkSession, benchmark: DataFrame, places: dict[str, tuple[str, str]], n: int | None = None, seed: int = 42) -> DataFrame:
    """id, text, source and ground_truth (JSON text) of the benchmark's rows whose text is there; n of them, by source and length, if given.

    A row without an id is known by its source and index.
    """
    full = corpus.hydrated(benchmark, texts_of(spark, places))
    known = F.coalesce(F.nullif(F.col("id"), F.lit("")), F.concat_ws("_", "source", "original_index"))
    full = full.withColumn("id", known).select("id", "text", "source", "ground_truth")
    return full if n is None else corpus.stratified_sample(full, n, [F.col("source"), spans.length_bin(F.col("text"))], "id", seed)


def main(argv: list[str] | None = None) -> None:
    """--benchmark PATH --corpus SOURCE=LAYOUT:PATH (repeated) --out PATH [--n N] [--seed S]"""
    p = argparse.ArgumentParser(description=__doc__, usage=main.__doc__)
    p.add_argument("--benchmark", required=True)
    p.add_argument("--corpus", action="append", default=[])
    p.add_argument("--out", required=True)
    p.add_argument("--n", type=int)
    p.add_argument("--seed", type=int, default=42)
    a = p.parse_args(argv)
    places = {}
    for c in a.corpus:
        source, _, rest = c.partition("=")
        layout, _, path = rest.partition(":")
        if layout not in corpora.LAYOUTS or not path:
            p.error(f"{c}: SOURCE=LAYOUT:PATH is expected, with a layout of {', '.join(corpora.LAYOUTS)}")
        places[source] = (layout, path)
    spark = SparkSession.builder.getOrCreate()
    bench = spark.read.schema(results.BENCHMARK).parquet(a.benchmark)
    json_array.write_arrays(build(spark, bench, places, a.n, a.seed), a.out)


if __name__ == "__main__":
    main()
