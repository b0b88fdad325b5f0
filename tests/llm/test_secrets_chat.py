"""Secret scans on planted strings and both native operators on very long rows."""

import random
import string

import pytest
from pyspark.sql import functions as F

from spanmill.llm import chat, secrets


@pytest.fixture(scope="module")
def model(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return secrets.train(secrets.random_strings(spark).unionByName(secrets.ordinary(docs)))


def test_recall_and_false_alarms_on_held_out_strings(spark, sf, model):
    rng = random.Random(11)
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    words = [w for r in docs for w in (r["text"] or "").split() if w.isalpha() and w.isascii() and 3 < len(w) < 12]
    b62, pick = string.ascii_letters + string.digits, lambda: rng.choice(words)
    draw = lambda al, n: "".join(rng.choice(al) for _ in range(n))
    secret = [draw(al, n) for al, n in ((b62, 16), (b62, 20), (b62, 32), (string.ascii_letters, 20), (string.ascii_letters, 32), ("0123456789ABCDEF", 32), (b62 + "+/", 40)) for _ in range(40)]
    plain = [s for make in (lambda: "_".join(pick() for _ in range(4)) + "_v2", lambda: "".join(pick().capitalize() for _ in range(4)), lambda: "-".join(pick() for _ in range(4)), lambda: "/".join(pick() for _ in range(5)), lambda: draw(string.digits, 16), lambda: "".join(pick() for _ in range(3))) for s in (make() for _ in range(40))]
    rows = [(1, f"the value here is {s} and so on") for s in secret] + [(0, f"the value here is {s} and so on") for s in plain]
    out = {r["k"]: r["s"] for r in secrets.scan(spark.createDataFrame(rows, "k int, text string"), model).groupBy("k").agg(F.avg((F.size("added") > 0).cast("int")).alias("s")).collect()}
    assert out[1] >= 0.97 and out[0] <= 0.02


def test_candidates_that_touch_base_spans_are_left(spark, model):
    key = "q7Zx9Lk2Vb8Tn4Rw6Yp1"
    rows = [(1, f"{key}password={key}"), (2, f"{key} password={key}"), (3, f"x{'0a' * 15}{key.replace('9', '.')}"), (4, None), (5, "")]
    got = {r["doc_id"]: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumns({"base": F.lit(1), "ADDED": F.lit(2)}), model).collect()}
    assert got[1]["added"] == [] and [(s["start"], s["stop"]) for s in got[2]["added"]] == [(0, 20)]
    assert got[4]["base"] == got[4]["added"] == got[5]["base"] == []
    assert all(not (a["start"] < b["stop"] and b["start"] < a["stop"]) for r in got.values() for a in r["added"] for b in r["base"])


def test_the_fit_is_bounded(spark):
    rows = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") < 2900, "the same identifier_text again").otherwise(F.concat(F.lit("identifier_"), F.col("id"))).alias("text"))
    assert 0 < secrets.ordinary(rows, n=10).count() <= 10 * 7 * 6
    assert secrets.ordinary(rows.limit(0)).count() == 0 and secrets.report(rows.limit(0)).count() == 0


def test_very_long_rows(spark):
    n = 100_000
    text = " ".join("a1" * 12 + str(i) for i in range(n))
    row = secrets.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).head()
    assert row["n_hex"] == n and row["spans"].endswith(f"{len(text) - 24 - len(str(n - 1))}:{len(text)}")
    turns = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("\U0001f600 ### "), F.col("id")).alias("text"))
    got = chat.report(turns.withColumns({"formatted": F.lit(1), "PARSED": F.lit(2)})).filter("conv_id = 1").head()
    assert got["n_turns"] == n and got["loss_chars"] == sum(6 + len(str(i)) for i in range(1, n, 2))
