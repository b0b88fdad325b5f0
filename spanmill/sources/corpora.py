"""Readers of three layouts of labelled corpora, with the language or locale filter at the scan.

The filter of read_corpus() compares folded values, row by row as they are read; read_exact() takes the spellings themselves, which
Parquet's statistics understand, and skips row groups without them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.operators import corpus


@dataclass(frozen=True)
class Layout:
    """Columns of the text, the labels and the language (None: one language), the labels' form, and the prefix of ids."""

    text: str
    labels: str
    language: str | None
    form: str
    prefix: str

    @property
    def schema(self) -> str:
        kinds = {"masks": "array<struct<label:string,value:string,start:long,end:long>>", "spans": "string", "entities": "array<struct<entity:string,types:array<string>>>"}
        own = f"{self.text} string, {self.labels} {kinds[self.form]}, original_index long"
        return own + (f", {self.language} string" if self.language else "")


# The columns of the three layouts.
LAYOUTS = {
    "masks": Layout("source_text", "privacy_mask", "language", "masks", "a_"),
    "spans": Layout("text", "spans", "locale", "spans", "b_"),
    "entities": Layout("text", "entities", None, "entities", "c_"),
}


def read_corpus(spark: SparkSession, path: str, layout: str | Layout, language: str | None = None, source: str | None = None) -> DataFrame:
    """id, source, original_index, text, types of the rows of a corpus in a language (folded; None: all), from Parquet.

    Labels are lists of objects, JSON text or Python text, as the layout says. Rows without original_index keep a null one. A null language is
    no language. Only the columns of the layout are read; the language is compared at the scan.
    """
    own = LAYOUTS[layout] if isinstance(layout, str) else layout
    rows = spark.read.schema(own.schema).parquet(path)
    if language is not None and own.language:
        wanted, c = language.strip().lower(), F.col(f"`{own.language}`")
        # null-rejecting, so that statistics of all-null groups are enough to skip them
        rows = rows.filter(c.isNotNull() & corpus.equals_folded(c, wanted))
    made = {"masks": corpus.normalise_masks, "spans": corpus.normalise_spans, "entities": corpus.normalise_entities}[own.form](rows, own.labels, own.prefix)
    return made.select("id", F.lit(source or own.form).alias("source"), "original_index", F.col(f"`{own.text}`").alias("text"), "types")


def read_exact(spark: SparkSession, path: str, layout: str, spellings: list[str], source: str | None = None) -> DataFrame:
    """read_corpus() for a corpus whose language has known spellings: equality is pushed down, and whole row groups are skipped."""
    own = LAYOUTS[layout]
    rows = spark.read.schema(own.schema).parquet(path).filter(F.col(own.language).isin(*spellings))
    made = {"masks": corpus.normalise_masks, "spans": corpus.normalise_spans}[own.form](rows, own.labels, own.prefix)
    return made.select("id", F.lit(source or own.form).alias("source"), "original_index", F.col(own.text).alias("text"), "types")


def summary(df: DataFrame, top: int = 10) -> DataFrame:
    """source, type, n, place: the `top` most frequent labels of each source; ties by name.

    Counts combine on the map side, and each task keeps the first of a source before they meet: no window holds a source's labels.
    """
    from pyspark.sql import Window

    counts = df.select("source", F.explode("types").alias("type")).groupBy("source", "type").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "type"))
    return counts.withColumn("place", place).filter(F.col("place") <= top)
