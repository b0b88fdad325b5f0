"""Labels, spans, matching and parsing against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from spanmill.functions import labels, spans, stats, text
from spanmill.operators import conversation, match

SPAN = "array<struct<type:string,text:string,start:int,stop:int>>"


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())] if values else [(1,)], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()) or "x int")
    return row.select(column.alias("out")).head()["out"]


def test_label_tables():
    assert len(labels.BASE) == 136 and sum(v is None for v in labels.BASE.values()) == 24 and len(labels.CANON) == 29
    assert labels.aligned()["GENDER"] == "GENDER" and labels.BASE["GENDER"] is None
    assert "ADDRESS" not in labels.aligned("no_address") and labels.aligned()["ADDRESS"] == "LOCATION"


@pytest.mark.parametrize(
    ("label", "full", "no_address", "no_date"),
    [("email-address", "EMAIL_ADDRESS", "EMAIL_ADDRESS", "EMAIL_ADDRESS"), ("EMAIL_ADDRESS_X", "EMAIL_ADDRESS", "EMAIL_ADDRESS", "EMAIL_ADDRESS"), ("home address", "LOCATION", "HOME_ADDRESS", "LOCATION"), ("visit date", "DATE_TIME", "DATE_TIME", "VISIT_DATE"), ("age", "UNKNOWN", "UNKNOWN", "UNKNOWN"), ("", "UNKNOWN", "UNKNOWN", "UNKNOWN")],
)
def test_symmetric(spark, label, full, no_address, no_date):
    got = spark.createDataFrame([(label,)], "l string").select(*[labels.symmetric(F.col("l"), v) for v in ("full", "no_address", "no_date")]).head()
    assert tuple(got) == (full, no_address, no_date)


def plain_iou(p, g):
    inter = max(0, min(p[2], g[2]) - max(p[1], g[1]))
    union = p[2] - p[1] + g[2] - g[1] - inter
    return inter / union if union > 0 else 0.0


def plain_tp(preds, gold, mode):
    used = set()
    for p in preds:
        for i, g in enumerate(gold):
            if i in used or p[0] != g[0]:
                continue
            bears = g[1] or g[2]
            if mode == "span" and bears and plain_iou(p, g) < 0.5:
                continue
            if mode == "strict" and bears and p[1:] != g[1:]:
                continue
            used.add(i)
            break
    return len(used)


def test_matching_equals_plain_python(spark):
    rng = random.Random(3)
    kinds = ["PERSON", "LOCATION", "URL"]

    def some():
        out = []
        for _ in range(rng.randint(0, 6)):
            s = rng.randint(0, 8)
            out.append((rng.choice(kinds), s, s + rng.randint(0, 5)) if rng.random() < 0.8 else (rng.choice(kinds), 0, 0))
        return out

    cases = [(i, some(), some()) for i in range(600)]
    pack = lambda xs: [(t, "x", s, e) for t, s, e in xs]
    df = spark.createDataFrame([(i, pack(p), pack(g)) for i, p, g in cases], f"key int, preds {SPAN}, gold {SPAN}")
    out = match.scored(df, (("type", "full", "t+"), ("span", "full", "s+"), ("strict", "full", "x+")))
    got = {r["key"]: r for r in out.collect()}
    for i, p, g in cases:
        r = got[i]
        assert [r["tp_t"], r["tp_s"], r["tp_x"]] == [plain_tp(p, g, m) for m in ("type", "span", "strict")]
        assert r["tp_s"] <= r["tp_t"] and r["tp_x"] <= r["tp_t"]
        for v in ("t", "s", "x"):
            assert 0 <= r[v] <= 1 and 0 <= r[f"p_{v}"] <= 1 and 0 <= r[f"r_{v}"] <= 1
        if not g:
            assert r["r_t"] == 1 and r["t"] == (0 if p else 1)


def test_offsets(spark):
    got = spark.createDataFrame([(x,) for x in ["5", " 5 ", "<REDACTED>", None, "--3", "-3"]], "r string").select(spans.offset(F.col("r")), spans.offset_digits(F.col("r"))).collect()
    assert [tuple(r) for r in got] == [(5, 5), (5, 0), (0, 0), (0, 0), (0, 0), (-3, -3)]


@pytest.mark.parametrize(
    ("response", "n"),
    [('```json\n[{"type": "A"}]\n```', 1), ('```\n[{"type": "A"}, {"x": 1}]\n```', 1), ('see [{"type": "A", "v": [1]}]', 0), ("none", 0), ("", 0), ('```json\n{"type": "A"}\n```', 0), ('```json\n{bad\n``` [{"type": "B"}]', 1)],
)
def test_answers(spark, response, n):
    assert len(one(spark, F.transform(text.answer(F.col("r")), lambda v: F.to_json(v)), r=response)) == n


def test_detectors_agree_with_re(spark):
    import re

    body = "Mail a.b@c.de or x@y.org; 10.0.0.1, 4785380592391139 ü 555-1234 end"
    got = one(spark, F.to_json(text.detect(F.col("t"))), t=body)
    expected = []
    for name, (pattern, _, _) in text.DETECTORS.items():
        for m in re.finditer(pattern, body):
            if not any(s < m.end() and m.start() < e for s, e, *_ in expected):
                expected.append((m.start(), m.end(), name, m[0]))
    assert [(x["start"], x["stop"], x["type"], x["text"]) for x in json.loads(got)] == sorted(expected)


def plain_discovery(kinds, cap):
    listed = viewed = executed = False
    for turn, k in enumerate(kinds, 1):
        if k == "list":
            listed = True
        elif k == "view":
            viewed = True
        elif k == "analyze":
            executed = True
        elif turn >= cap:
            return (turn, listed, viewed, executed or k != "answer", "answer" if k == "answer" else "tool")
        elif k == "answer" and executed:
            return (turn, listed, viewed, True, "answer")
        if turn >= cap:
            return (turn, listed, viewed, True, "tool")
    return None


def test_discovery_replay(spark):
    import itertools

    cases = list(itertools.product(["list", "view", "analyze", "answer", "none"], repeat=5))
    df = spark.createDataFrame([(list(c),) for c in cases], "k array<string>")
    out = df.select("k", conversation.discovery(F.col("k")).alias("s")).collect()
    for r in out:
        assert (r["s"]["turn"], r["s"]["listed"], r["s"]["viewed"], r["s"]["executed"], r["s"]["outcome"]) == plain_discovery(r["k"], 5), r["k"]


def test_agent_cap(spark):
    df = spark.createDataFrame([([["a"], ["b", "c"], [], ["d"]],), ([["a"], ["b", "c", "d"], ["e"]],)], "c array<array<string>>")
    assert [r[0] for r in df.select(conversation.agent(F.col("c"), 3)).collect()] == [["a", "b", "c"], ["a", "b", "c", "d"]]


def test_t_distribution():
    for df, t in ((1, 12.706204736), (10, 2.228138852), (1999, 1.961152)):
        assert abs(stats.t_two_sided(t, df) - 0.05) < 1e-5 and abs(stats.t_quantile(df) - t) < 1e-4
    assert stats.t_quantile(0) is None and stats.t_two_sided(None, 5) is None


def test_constant_input_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert df.agg(stats.safe_corr(F.col("x"), F.col("y"))).head()[0] is None


def test_redaction_of_overlaps(spark):
    s = F.from_json(F.lit('[{"type":"A","text":"x","start":0,"stop":4},{"type":"B","text":"x","start":2,"stop":6}]'), SPAN)
    assert one(spark, spans.redact_merged(F.col("t"), s), t="abcdefgh") == "[A]gh"


def test_answers_are_cut_as_the_patterns_would(spark):
    """The first place of each kind, with its white space, as Python's patterns find it; the texts hold marks in many orders."""
    import itertools
    import re

    from spanmill.functions import text

    places = [r"```json\s*([\s\S]*?)\s*```", r"```\s*([\s\S]*?)\s*```", r"(\[[\s\S]*?\])"]
    parts = ["```json", "```", "`", "[", "]", '[{"type": 1}]', " \n\v\t", "x", "é😀"]
    texts = ["".join(p) for p in itertools.product(parts, repeat=4)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", *[text._between(F.col("t"), *m).alias(str(i)) for i, m in enumerate(text.ANSWER)])
    for row in df.collect():
        for i, p in enumerate(places):
            m = re.search(p, row["t"], re.ASCII)
            assert row[str(i)] == (m and m.group(1)), (row["t"], p)


def test_json_lists_and_items_with_a_type(spark):
    from spanmill.functions import text

    values = ["[]", "[1]", "{}", "null", '"[1]"', "3", "", None, "[", '[{"type": null}, {"x": {"type": 1}}, [{"type": 1}], null, "type", {"x": 1, "type": [2]}]']
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", F.size(text.json_list(F.col("v"))).alias("n"), F.to_json(text.with_type(text.json_list(F.col("v")))).alias("w"))
    got = {r["v"]: (r["n"], r["w"]) for r in df.collect()}
    assert {v: n for v, (n, _) in got.items() if n is not None and n >= 0} == {"[]": 0, "[1]": 1, values[-1]: 6}
    assert got[values[-1]][1] == '[{"type":null},{"type":[2],"x":1}]'


def test_spans_are_read_without_json_text_between(spark):
    """Before, items were written as JSON text and parsed again, and a fraction of many digits lost some."""
    from spanmill.functions import text

    item = '[{"type": %s, "text": "a\\n\\"b\\"", "start": " 7 ", "end": %s, "more": [1]}, {"type": null}, {"type": {"k": [1]}, "start": 1.5}]'
    values = [item % ('"A"', "9"), item % ("12345678901.123456789", '"x"'), "[]", "{}", None]
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", text.read_spans(text.with_type(text.json_list(F.col("v")))).alias("s"))
    got = {r["v"]: r["s"] and [tuple(x) for x in r["s"]] for r in df.collect()}
    rest = [(None, None, 0, 0), ('{"k":[1]}', None, 0, 0)]
    assert got == {values[0]: [("A", 'a\n"b"', 7, 9), *rest], values[1]: [("12345678901.123456789", 'a\n"b"', 7, 0), *rest], "[]": [], "{}": None, None: None}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan and "map<string,variant>" not in plan


def test_a_lookup_reads_one_short_map_of_a_table(spark):
    """Every name of every table, with quotes in names, by a hash that Spark and the driver compute alike; before, all names were read one by one."""
    from spanmill.functions import labels

    names = sorted({*labels.BEFORE, *labels.aligned(), "", "NO SUCH", "X\\Y"})
    df = spark.createDataFrame([(n,) for n in [*names, None]], "k string")
    got = df.select("k", *[labels._lookup(t, F.col("k"), null, F.lit("absent")).alias(c) for c, t, null in (("base", labels.BASE, None), ("full", labels.aligned(), "none"))]).collect()
    for r in got:
        assert r["base"] == (labels.BASE.get(r["k"]) or "absent")
        assert r["full"] == ((labels.aligned()[r["k"]] or "none") if r["k"] in labels.aligned() else "absent")
    assert max(len(m) for m in labels._slots(tuple((k, v) for k, v in labels.aligned().items() if v)).split("map(")) < 400
