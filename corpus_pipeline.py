"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the
columns of documents; n_chars follows the text.

- language_id (op 10) drops documents in which no language can be told - null texts and texts without letters - and
  sets lang where it is null.
- line_dedup (op 2) removes lines that match an earlier line; documents of which nothing is left go.
- near_dedup (op 8) keeps the document of smallest doc_id of each class.
- decontaminate (op 9) drops contaminated documents.
- encode (op 1) adds n_tokens, token_ids (packed little-endian uint32) and whether they decode to the text.

Every stage takes null and repeated ids, null, empty and very long texts, repeated rows, empty tables and further columns, which stay; only
columns named as those that encode adds give way to them.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.llm import bpe, decontam, langid, linededup, minhash
from spanmill.llm.common import cut, table


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


#: The setting for rows of a batch that goes to Python, its default, and what texts take instead: a batch is held by the JVM and by Python.
BATCH, DEFAULT, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"


def stage(f):
    """A stage whose batches hold ROWS texts at most, unless the session has a setting of its own."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get(BATCH) == DEFAULT:
            spark.conf.set(BATCH, ROWS)
        return f(spark, docs, sf_dir)

    return run_stage


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name like this one that docs does not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


@stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter, lang filled where it is null. Without any lang to learn from none is filled."""
    if "lang" not in docs.columns:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    model = langid.fit(docs.filter(~langid.held_out(F.col("doc_id"))))
    if not model.langs:  # nothing to learn from: a text with letters is no worse for it
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    lang, score = _fresh(docs, "lang_pred"), _fresh(docs, "lang_score")
    told = langid.predict(docs, model, lang_pred=lang, score=score).filter(F.col(lang) != langid.UND)
    return told.withColumn("lang", F.coalesce("lang", lang)).select(*[F.col(f"`{c}`") for c in docs.columns])


@stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that match an earlier one; those of blank lines alone go."""
    out = linededup.dedup(docs)
    return _counted(out.filter(F.col("text").rlike(r"(?U)[^\s\x1c-\x1f]")))


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return minhash.one_of_each(docs)


@stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated. A verdict belongs to an id and its text, as ids may be null or repeated."""
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    keyed = docs.select(F.struct("doc_id", digest.alias("digest")).alias("key"), "text")
    found = decontam.decontaminate(keyed, table(spark, sf_dir, "benchmark"), key="key")
    own, theirs, same = (_fresh(docs, n) for n in ("own_digest", "bad_id", "bad_digest"))
    bad = cut(found.filter(decontam.contaminated()).select(F.col("key.doc_id").alias(theirs), F.col("key.digest").alias(same)).distinct(), "contaminated")
    marked = docs.withColumn(own, digest)
    return marked.join(bad, F.col("doc_id").eqNullSafe(F.col(theirs)) & (F.col(own) == F.col(same)), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their tokens; a null text has none."""
    back = _fresh(docs, "decoded_text")
    done = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded=back)
    return done.withColumn("decodes", F.col(back).eqNullSafe(F.coalesce("text", F.lit("")))).drop(back)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

#: SQL cannot express the stages; tests/llm/test_pipeline.py holds them against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
