"""Registered queries do the whole job: no prefixes, no rows left out."""

import bisect
import math
from collections import defaultdict

import duckdb
import numpy as np
from pyspark.sql import functions as F

from spanmill.functions import stats
from spanmill.operators import match
from spanmill.plans import catalog
from spanmill.plans.fixtures import records

SF = "/root/testdata/sf0.001"


def test_prompts_hold_whole_texts(spark):
    texts = dict(duckdb.sql(f"select doc_id, coalesce(text, '') from '{SF}/documents.parquet'").fetchall())
    got = {r["doc_id"]: r["prompt"] for r in catalog.QUERIES["h19_prompt_render"](spark, SF).collect()}
    assert got == {i: "Find " + t + " in {{x}}: " + t for i, t in texts.items()}


def test_offline_scorer_reads_unparseable_answers(spark):
    expected: dict = {}
    for r in records(spark, SF).select("key", "model", "condition", "preds", "gold").collect():
        n = expected.setdefault((r["model"], r["condition"]), [0, 0])
        n[0] += 0 if r["key"] % 5 == 3 else len(r["preds"])  # responses() breaks the JSON of these
        n[1] += len(r["gold"])
    got = catalog.QUERIES["j10_offline_scorer"](spark, SF).collect()
    assert {(r["model"], r["condition"]): [r["n_pred"], r["n_gold"]] for r in got} == expected


def plain_weight(h, draw):
    """Poisson(1) by SplitMix64's finalizer, in whole numbers."""
    m = (1 << 64) - 1
    z = (h + draw * 0x9E3779B97F4A7C15) & m
    z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 & m
    z = (z ^ (z >> 27)) * 0x94D049BB133111EB & m
    steps = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(7)]
    return bisect.bisect_right(steps, ((z ^ (z >> 31)) >> 24) / 2**40)


def plain_bootstrap(rows, draws):
    """rows of (group, value, unsigned hash of the key) to group -> (low, high)."""
    means, cache = defaultdict(list), {}
    for d in range(1, draws + 1):
        n, s = defaultdict(float), defaultdict(float)
        for g, v, h in rows:
            if v is not None:
                w = cache.get((h, d))
                if w is None:
                    w = cache[h, d] = plain_weight(h, d)
                n[g] += w
                s[g] += w * v
        for g in n:
            if n[g]:
                means[g].append(s[g] / n[g])
    return {g: tuple(np.percentile(m, [2.5, 97.5])) for g, m in means.items()}


def hashed(df, *by):
    return [(tuple(r[:-2]), r["v"], r["h"] % 2**64) for r in df.select(*by, "v", F.xxhash64(F.lit(42), F.col("key").cast("string")).alias("h")).collect()]


def test_bootstrap_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(stats, "HELD", 1)
    rows = [("a" if i % 3 else None, i % 2, i // 2, float(i % 7) if i % 11 else None) for i in range(120)]
    df = spark.createDataFrame(rows, "g string, k int, key long, v double").repartition(3)
    expected = plain_bootstrap(hashed(df, "g", "k"), 60)
    got = {(r["g"], r["k"]): (r["low"], r["high"]) for r in stats.bootstrap(df, ["g", "k"], "v", "key", 60).collect()}
    assert got.keys() == expected.keys() and all(np.allclose(got[g], expected[g], rtol=0, atol=1e-12) for g in expected)


def test_registered_bootstrap_has_the_draws_of_the_operator(spark):
    df = match.scored(records(spark, SF), (("span", "full", "fs"),)).filter("model = 'm1' and condition = 'cot'").withColumnRenamed("fs", "v")
    expected = plain_bootstrap(hashed(df, "model", "condition"), 1000)
    got = {(r["model"], r["condition"]): (r["low"], r["high"]) for r in catalog.QUERIES["i3_bootstrap"](spark, SF).collect()}
    assert len(got) == 30 and all(np.allclose(got[g], expected[g], rtol=0, atol=1e-6) for g in expected)
    w = stats.weights(np.arange(2000, dtype=np.uint64) * np.uint64(2654435761), 1000)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.01


def test_top_up_fills_from_all_documents(spark):
    for sf in (SF, "/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        docs = duckdb.sql(f"select doc_id, source from '{sf}/documents.parquet'").fetchall()
        have = [r for r in docs if r[0] % 10 == 0]
        rest = sorted((r for r in docs if r[0] % 10), key=lambda r: (r[1], r[0]))
        need = len(docs) * 15 // 100 - len(have)
        got = catalog.QUERIES["c4_top_up"](spark, sf).collect()
        assert need > 0 and sorted(map(tuple, got)) == sorted(have + rest[:need])
