"""The queries op1 to op13 and the pipeline, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanmill.llm import bpe, chat, decontam, htmltext, langid, linededup, minhash, mixing, quality, secrets, sortmeans, trie, warc
from spanmill.llm.common import table


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(table(spark, sf_dir, "documents"))


def op3_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(spark, sf_dir)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.report(table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(table(spark, sf_dir, "conversations"))


def op8_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op11_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sortmeans.report(table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.report(table(spark, sf_dir, "conversations"))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_round_trip": op1_bpe_round_trip,
    "op2_line_dedup": op2_line_dedup,
    "op3_arc_to_warc": op3_arc_to_warc,
    "op4_secret_scan": op4_secret_scan,
    "op5_html_text": op5_html_text,
    "op6_quality_rules": op6_quality_rules,
    "op7_chat_format": op7_chat_format,
    "op8_bag_minhash": op8_bag_minhash,
    "op9_decontaminate": op9_decontaminate,
    "op10_language_id": op10_language_id,
    "op11_sort_means": op11_sort_means,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_source_mix": op13_source_mix,
    "pipeline": pipeline,
}
ORACLES: dict[str, str] = {
    "op2_line_dedup": linededup.ORACLE_SQL,
    "op3_arc_to_warc": warc.ORACLE_SQL,
    "op7_chat_format": chat.ORACLE_SQL,
    "op9_decontaminate": decontam.ORACLE_SQL,
    "op11_sort_means": sortmeans.ORACLE_SQL,
    "op12_prefix_trie": trie.ORACLE_SQL,
    "op13_source_mix": mixing.ORACLE_SQL,
}
