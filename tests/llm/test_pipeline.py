"""The pipeline's stages against brute-force versions, and all SQL twins."""

import json
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanmill.llm import queries
from test_ops import ODD, plain_classes, plain_hits, plain_removed

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = duckdb.sql(f"select item_id, text from '{sf}/benchmark.parquet'").fetchall()
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        rows = out.collect()
        after = {r["doc_id"]: r["text"] for r in rows}
        assert len(rows) == len(after)
        if name == "language_id":
            assert after == {i: t for i, t in before.items() if re.search(r"[^\W\d_]", t)}
        elif name == "line_dedup":
            gone = plain_removed(sorted(before.items()))
            left = {i: "\n".join(x for j, x in enumerate(t.split("\n")) if j not in set(gone[i])) for i, t in before.items()}
            assert after == {i: t for i, t in left.items() if t.strip()}
        elif name == "near_dedup":
            own = plain_classes(sorted(before.items()))
            assert after == {i: t for i, t in before.items() if own[i] == i}
        elif name == "decontaminate":
            bad = {r[0] for r in plain_hits(before.items(), bench) if r[5]}
            assert bad and after == {i: t for i, t in before.items() if i not in bad}
        else:
            assert after == before and all(r["decodes"] and len(r["token_ids"]) == 4 * r["n_tokens"] for r in rows)
            break
        assert out.columns == COLUMNS and all(r["n_chars"] == len(r["text"]) for r in rows if name != "language_id")
        docs = spark.createDataFrame(rows, docs.schema)
        before = after


def test_stages_take_odd_rows(spark, sf):
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 1) for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long, extra int")
    for docs in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            assert out.columns[:6] == docs.columns and out.count() <= docs.count()


def test_language_stage_without_languages(spark, sf):
    kept = [(1, "some text", None), (2, "\u0416", None)]
    docs = spark.createDataFrame([*kept, (3, "12 !?_", None), (4, "", None), (5, None, None)], "doc_id long, text string, lang string")
    assert sorted(map(tuple, corpus_pipeline.language_id(spark, docs, sf).collect())) == kept


def test_stages_keep_columns_of_any_name(spark, sf):
    names = ["__digest", "__id", "__lang", "__score", "own_digest", "lang_pred", "lang_score", "bad_id", "decoded_text", "key", "__node", "__KEY", "__list", "__gone", "__many", "__row", "__first", "__stays", "__alone"]
    docs = spark.createDataFrame([(1, "some text of its own", None, 1), (2, "another text, longer than that", "en", 2)], "doc_id long, text string, lang string, n int")
    docs = docs.withColumns({c: F.lit(c) for c in names})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        kept = [c for c in docs.columns if c in out.columns]
        rows = out.collect()
        assert kept == docs.columns and len(rows) == 2 and all(r[c] == c for r in rows for c in names), name
        if name == "language_id":
            assert {r["doc_id"]: r["lang"] for r in rows} == {1: "en", 2: "en"}


def test_decontaminate_judges_rows_not_ids(spark, sf):
    passage = duckdb.sql(f"select text from '{sf}/benchmark.parquet' order by item_id limit 1").fetchall()[0][0]
    clean = [(None, "a clean text without an id"), (None, None), (1, "a clean text of a repeated id"), (2, "another clean text"), (2, "another clean text")]
    docs = spark.createDataFrame([*clean, (None, passage), (1, passage), (3, passage)], "doc_id long, text string")
    out = corpus_pipeline.decontaminate(spark, docs, sf)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect()), key=repr) == sorted(clean, key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_twin(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations", "embeddings"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, expected = queries.QUERIES[name](spark, sf).toPandas(), c.sql(queries.ORACLES[name]).df()

    def as_rows(df):
        df = df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None)
        return sorted(json.dumps([int(x) if isinstance(x, float) else x for x in r], default=str) for r in df.values.tolist())

    assert sorted(got.columns) == sorted(expected.columns) and as_rows(got) == as_rows(expected)


def test_every_query_is_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {*[f"op{i}" for i in range(1, 14)], "pipeline"}
