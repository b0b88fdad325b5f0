"""Queries of text functions, conversations, runs, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanmill.functions import spans, text
from spanmill.operators import conversation as C
from spanmill.operators import corpus, match, runner
from spanmill.plans.corpus_queries import BIN, CORPUS_SQL, STRICT_SQL, sample_sql, typed
from spanmill.plans.fixtures import CARDS_SQL, RECORDS_SQL, cards, records, scored_sql, table
from spanmill.plans.registry import query, r6
from spanmill.sources import results
from spanmill.sources.paths import shared_dir

# ---- detectors ----

for _kind, (_pattern, _, _) in text.DETECTORS.items():
    _re = _pattern.replace("'", "''")

    @query(
        f"k_detect_{_kind.lower()}",
        f"""WITH m AS (SELECT doc_id, regexp_extract_all(text, '{_re}') AS h, regexp_split_to_array(text, '{_re}') AS g FROM documents WHERE regexp_matches(text, '{_re}')),
p AS (SELECT doc_id, h, g, unnest(range(1, len(h) + 1)) AS i FROM m),
s AS (SELECT doc_id, h[i] AS text, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start FROM p)
SELECT doc_id, start, start + length(text) AS stop, text FROM s""",
    )
    def _(spark, d, pattern=_pattern):
        found = table(spark, d, "documents").select("doc_id", F.explode(text.matches(F.col("text"), pattern)).alias("m"))
        return found.select("doc_id", F.col("m.start").cast("long").alias("start"), F.col("m.stop").cast("long").alias("stop"), "m.text")


def _matches_sql(kind: str, i: int) -> str:
    pattern, confidence, risk = text.DETECTORS[kind]
    pattern = pattern.replace("'", "''")
    return f"""m{i} AS (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS h, regexp_split_to_array(text, '{pattern}') AS g FROM documents WHERE regexp_matches(text, '{pattern}')),
p{i} AS (SELECT doc_id, h, g, unnest(range(1, len(h) + 1)) AS i FROM m{i}),
f{i} AS (SELECT doc_id, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start, h[i] AS text, '{kind}' AS type, {risk} AS risk_level, {confidence} / 100.0::DOUBLE AS confidence FROM p{i}),
k{i} AS (SELECT *, start + length(text) AS stop FROM f{i} n WHERE NOT EXISTS (FROM ({' UNION ALL '.join(f"SELECT doc_id, start, stop FROM k{j}" for j in range(i)) or "SELECT 0 AS doc_id, 0 AS start, 0 AS stop WHERE false"}) o
  WHERE o.doc_id = n.doc_id AND o.start < n.start + length(n.text) AND n.start < o.stop))"""


@query("k_detect_all", "WITH " + ", ".join(_matches_sql(kind, i) for i, kind in enumerate(text.DETECTORS)) + " " + " UNION ALL ".join(f"SELECT doc_id, start, stop, type, text, risk_level, confidence FROM k{i}" for i in range(len(text.DETECTORS))))
def _(spark, d):
    found = table(spark, d, "documents").select("doc_id", F.explode(text.detect(F.col("text"))).alias("m"))
    return found.select("doc_id", "m.*")


@query("j13_detector_run", f"WITH {CARDS_SQL}, s AS (SELECT source, CASE WHEN key % 3 = 0 THEN 2.0 * 2 / 6 ELSE 2.0 * 2 / 6 END AS f FROM cards) SELECT source, count(*) AS n, round(avg(f)::DOUBLE, 6) AS f1 FROM s GROUP BY source")
def _(spark, d):
    run = runner.detector_run(cards(spark, d))
    return match.scored(run, (("span", "full", "f1"),)).groupBy("source").agg(F.count("*").alias("n"), r6(F.avg("f1")).alias("f1"))


# ---- redaction and rendering ----


_PIECES = " || ".join(f"substr(text, {'1' if i == 0 else f'gold0[{i}].stop + 1'}, (gold0[{i + 1}].start{'' if i == 0 else f' - gold0[{i}].stop'})::BIGINT) || '[' || gold0[{i + 1}].type || ']'" for i in range(4))


@query("h18_typed_redaction", f"WITH {CARDS_SQL} SELECT key, {_PIECES} || substr(text, gold0[4].stop + 1) AS redacted FROM cards")
def _(spark, d):
    return cards(spark, d).select("key", spans.redact_text(F.col("text"), F.col("gold0")).alias("redacted"))


@query("z15_merged_redaction", f"WITH {CARDS_SQL} SELECT key, 'Contact [PERSON] in [LOCATION].' AS redacted FROM cards")
def _(spark, d):
    g = F.col("gold0")
    wide = F.struct(F.lit("PERSON").alias("type"), g[0]["text"].alias("text"), g[0]["start"].alias("start"), (g[1]["start"] + 2).alias("stop"))
    over = F.struct(F.lit("EMAIL_ADDRESS").alias("type"), g[1]["text"].alias("text"), g[1]["start"].alias("start"), g[2]["stop"].alias("stop"))
    return cards(spark, d).select("key", spans.redact_merged(F.col("text"), F.array(g[3], over, wide)).alias("redacted"))


@query("b17_redact_projection", f"WITH {RECORDS_SQL} SELECT key, model, condition, len(preds) AS hidden FROM records")
def _(spark, d):
    hidden = F.size(F.filter(spans.redacted(F.col("preds")), lambda s: s["text"] == "[REDACTED]")).cast("long")
    return records(spark, d).select("key", "model", "condition", hidden.alias("hidden"))


@query("h19_prompt_render", "SELECT doc_id, replace('Find {text} in {{x}}: {text}', '{text}', coalesce(text, '')) AS prompt FROM documents")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return runner.prompts(docs, {"zero_shot": "Find {text} in {{x}}: {text}"}, ["m0"]).select("doc_id", "prompt")


_TAILS = {0: ["list_skills"], 1: ["list_skills", "view_skill"], 2: ["view_skill", "analyze_pii"], 3: [], 4: []}


def _follow_sql() -> str:
    shown = lambda n: f"'You called {n}. Here are the results:' || chr(10) || chr(10) || '```json' || chr(10) || '{n} ' || first || chr(10) || '```'"
    gap, next_ = " || chr(10) || chr(10) || ", " || chr(10) || chr(10) || 'Your next reply must be exactly: "
    final = "'You called the analyze_pii tool. Here are the results:' || chr(10) || chr(10) || '```json' || chr(10) || 'analyze_pii ' || first || chr(10) || '```' || chr(10) || chr(10) || 'Now format your final answer as a JSON array. Each PII item should have: type, text, start, end.' || chr(10) || 'Only output the JSON array, nothing else.'"
    return f"""SELECT conv_id, CASE conv_id % 5 WHEN 0 THEN {shown('list_skills')}{next_}[TOOL_CALL: view_skill pii-detection]' WHEN 1 THEN {shown('list_skills')}{gap}{shown('view_skill')}{next_}[TOOL_CALL: analyze_pii]'
  WHEN 2 THEN {final} WHEN 3 THEN '[user]' || chr(10) || first || chr(10) || chr(10) || '[system]' || chr(10) || 's' ELSE first END AS prompt
  FROM (SELECT conv_id, coalesce(arg_min(text, turn), '') AS first FROM conversations GROUP BY conv_id)"""


@query("h20_follow_up", _follow_sql())
def _(spark, d):
    first = table(spark, d, "conversations").groupBy("conv_id").agg(F.coalesce(F.min_by("text", "turn"), F.lit("")).alias("first"))
    k = F.col("conv_id") % 5
    tail = F.array().cast("array<struct<name:string,content:string>>")
    for i, names in _TAILS.items():
        if names:
            tail = F.when(k == i, F.array(*[F.struct(F.lit(n).alias("name"), F.concat(F.lit(f"{n} "), "first").alias("content")) for n in names])).otherwise(tail)
    return first.select("conv_id", C.follow_up(F.col("first"), tail, F.when(k == 3, "s")).alias("prompt"))


_CHUNKS = "list_filter(list_transform(string_split(replace(text, '. ', chr(10) || '## '), chr(10) || '## '), lambda c: trim(c)), lambda c: c <> '')"


@query("h21_doc_chunks", f"SELECT doc_id, len({_CHUNKS})::BIGINT + 1 AS n, array_to_string(list_append({_CHUNKS}, 'skill'), '|') AS chunks FROM documents WHERE text <> ''")
def _(spark, d):
    body = F.replace(F.col("text"), F.lit(". "), F.lit("\n## "))
    parts = C.chunks(body, F.lit("skill"), 1 << 30)
    return table(spark, d, "documents").filter("text <> ''").select("doc_id", F.size(parts).cast("long").alias("n"), F.array_join(parts, "|").alias("chunks"))


@query("h23_analyser_output", f"WITH {CARDS_SQL} SELECT key, sum(CASE WHEN g.start = 0 THEN 0 ELSE length(g.text) END)::BIGINT AS shown FROM (SELECT key, unnest(gold) AS g FROM cards) GROUP BY key")
def _(spark, d):
    shown = F.aggregate(F.transform("gold", lambda g: F.when(g["start"] == 0, "").otherwise(g["text"])), F.lit(0), lambda n, t: n + F.length(t))
    return cards(spark, d).select("key", shown.cast("long").alias("shown"))


# ---- model output ----


def responses(spark, d):
    """records with a response of one of five shapes."""
    item = F.transform("preds", lambda p: F.to_json(F.struct(p["type"].alias("type"), p["start"].alias("start"))))
    bare = F.concat(F.lit("["), F.array_join(item, ", "), F.lit("]"))
    k = F.col("key") % 5
    mixed = F.concat(F.lit('[1, {"label": "x"}, null'), F.array_join(F.transform(item, lambda i: F.concat(F.lit(", "), i)), ""), F.lit("]"))
    shape = (
        F.when(k == 0, F.concat(F.lit("Sure.\n```json\n"), bare, F.lit("\n```\nDone.")))
        .when(k == 1, bare)
        .when(k == 2, F.concat(F.lit("Here it is: "), bare, F.lit(" and that is all.")))
        .when(k == 3, F.concat(F.lit('[{"type": "PERSON"'), F.array_join(item, " ")))
        .otherwise(mixed)
    )
    return records(spark, d).withColumn("response", shape)


@query("h12_json_answer", f"WITH {RECORDS_SQL} SELECT key, model, condition, CASE WHEN key % 5 = 3 THEN 0 ELSE len(preds) END AS n_items FROM records")
def _(spark, d):
    return responses(spark, d).select("key", "model", "condition", F.size(text.answer(F.col("response"))).cast("long").alias("n_items"))


@query("h12_answer_content", f"WITH {RECORDS_SQL} SELECT key, model, condition, CASE WHEN key % 5 = 3 THEN '' ELSE array_to_string(list_transform(preds, lambda p: p.type || '@' || p.start), ' ') END AS items FROM records")
def _(spark, d):
    items = F.transform(text.answer(F.col("response")), lambda v: F.concat_ws("@", F.try_variant_get(v, "$.type", "string"), F.try_variant_get(v, "$.start", "string")))
    return responses(spark, d).select("key", "model", "condition", F.array_join(items, " ").alias("items"))


_B11 = "CASE (key + i) % 4 WHEN 0 THEN '{\"type\": \"A\"}' WHEN 1 THEN '{\"type\": null}' WHEN 2 THEN '{\"x\": 1}' ELSE '3' END"


@query("b11_valid_predictions", f"WITH {RECORDS_SQL} SELECT key, model, condition, CASE WHEN key % 7 = 0 THEN 0 ELSE len(list_filter(range(0, len(preds)), lambda i: (key + i) % 4 IN (0, 1))) END AS n FROM records")
def _(spark, d):
    """One item a prediction, by turns with a type, with a null type, without one and no object; every seventh is no list."""
    items = F.transform("preds", lambda p, i: F.element_at(F.array(F.lit('{"type": "A"}'), F.lit('{"type": null}'), F.lit('{"x": 1}'), F.lit("3")), ((F.col("key") + i) % 4 + 1).cast("int")))
    listed = F.concat(F.when(F.col("key") % 7 == 0, '{"type": "A", "more": [').otherwise("["), F.array_join(items, ", "), F.when(F.col("key") % 7 == 0, "]}").otherwise("]"))
    return records(spark, d).select("key", "model", "condition", F.coalesce(F.size(text.with_type(text.json_list(listed))), F.lit(0)).cast("long").alias("n"))


CALLS = [
    (1, "[TOOL_CALL: list_skills].", "list_skills", None),
    (2, "text\n  [tool_call: view_skill pii-detection]  \nmore", "view_skill", "pii-detection"),
    (3, "I say [TOOL_CALL : analyze_pii ] now", "analyze_pii", None),
    (4, "[TOOL_CALL: analyze_pii]\n[TOOL_CALL: list_skills]", "analyze_pii", None),
    (5, "x [TOOL_CALL: analyze_pii] then [TOOL_CALL: list_skills]", "list_skills", None),
    (6, "Let me list skills first", "list_skills", None),
    (7, "please review the results", "view_skill", "results"),
    (8, 'view_skill("pii-detection")', "view_skill", "pii-detection"),
    (9, "I will use the detection tool", "analyze_pii", None),
    (10, "calling analyze_pii()", "analyze_pii", None),
    (11, "Nothing to do here", None, None),
    (12, "", None, None),
]


def call_rows(spark, d, calls=None):
    """Turns of conversations that end with one of the calls: conv_id, turn, id, lead (the turn's text) and response."""
    calls = CALLS if calls is None else calls
    at = ((F.col("conv_id") * 5 + F.col("turn")) % len(calls)).cast("int")
    own = table(spark, d, "conversations").select("conv_id", "turn", (at + 1).alias("id"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).alias("lead"))
    return own.withColumn("response", F.concat("lead", F.element_at(F.array(*[F.lit(c[1]) for c in calls]), F.col("id"))))


def _values(rows, cols: str) -> str:
    cell = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, (bool, int)) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) t({cols})"


def _called(rows, cols: str, n: int, keep: str = "") -> str:
    """What is expected of each turn: that of its call."""
    names = ", ".join(c.strip() for c in cols.split(",")[1:])
    return f"WITH v AS ({_values(rows, cols)}), c AS (SELECT conv_id, turn, coalesce(text, '') || chr(10) AS lead, ((conv_id * 5 + turn) % {n} + 1)::INTEGER AS id FROM conversations) SELECT conv_id, turn, {keep or names} FROM c JOIN v USING (id)"


@query("h13_tool_call", _called([(i, tool, p) for i, _, tool, p in CALLS], "id, tool, param", len(CALLS)))
def _(spark, d):
    return call_rows(spark, d).select("conv_id", "turn", text.tool_call(F.col("response")).alias("c")).select("conv_id", "turn", "c.tool", "c.param")


@query("h14_asks_to_analyze", _called([(i, i in (3, 4, 5, 10) or i == 9) for i, *_ in CALLS], "id, asks", len(CALLS)))
def _(spark, d):
    return call_rows(spark, d).select("conv_id", "turn", text.asks_to_analyze(F.col("response")).alias("asks"))


STRUCTURED = [
    (1, '<tool_call> {"name": "a", "arguments": {"x": 1}} </tool_call>', "a", '{"x":1}'),
    (2, '<tool_call>{"name": "a", </tool_call>', None, None),
    (3, 'so {"name": "b", "parameters": {"y": "z"}} it is', "b", '{"y":"z"}'),
    (4, "[TOOL_CALL: view_skill pii-detection]", "view_skill", '{"skill_name":"pii-detection"}'),
    (5, "[TOOL_CALL: list_skills]", "list_skills", "{}"),
    (6, "no call", None, None),
]


@query("h15_structured_call", _called([(i, tool, a) for i, _, tool, a in STRUCTURED], "id, tool, arguments", len(STRUCTURED)))
def _(spark, d):
    return call_rows(spark, d, STRUCTURED).select("conv_id", "turn", text.structured_call(F.col("response")).alias("c")).select("conv_id", "turn", "c.tool", "c.arguments")


_ALL = [(1, "list_skills"), (2, "view_skill pii-detection"), (3, "analyze_pii"), (4, "analyze_pii,list_skills"), (5, "analyze_pii,list_skills")]


@query("h16_all_calls", _called([*_ALL, *[(i, "") for i in range(6, len(CALLS) + 1)]], "id, calls", len(CALLS)))
def _(spark, d):
    return call_rows(spark, d).select("conv_id", "turn", F.array_join(text.all_calls(F.col("response")), ",").alias("calls"))


_CUT = {4: "[TOOL_CALL: analyze_pii]\n", 5: "x [TOOL_CALL: analyze_pii]", 1: "[TOOL_CALL: list_skills]", 2: "text\n  [tool_call: view_skill pii-detection]  \n", 3: "I say [TOOL_CALL : analyze_pii ]"}


@query("h17_until_first_call", _called([(i, _CUT.get(i, t)) for i, t, _, _ in CALLS], "id, cut", len(CALLS), "lead || cut AS cut"))
def _(spark, d):
    # a call that ends no line leaves the cut right behind it
    return call_rows(spark, d).select("conv_id", "turn", text.until_first_call(F.col("response")).alias("cut"))


# ---- conversations ----


@query("e3_last_assistant", "SELECT conv_id, arg_max(text, turn) AS final FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def _(spark, d):
    return C.last_message(table(spark, d, "conversations"))


@query("e4_trailing_run", "SELECT conv_id, count(*) FILTER (role = 'assistant' AND turn > coalesce(o, -1)) AS run FROM (SELECT *, max(turn) FILTER (role <> 'assistant') OVER (PARTITION BY conv_id) AS o FROM conversations) GROUP BY conv_id")
def _(spark, d):
    return C.trailing_run(table(spark, d, "conversations"), "assistant")


SCRIPT = ["[TOOL_CALL: list_skills]", "[TOOL_CALL: view_skill pii-detection]", "[TOOL_CALL: analyze_pii]", '```json\n[{"type": "PERSON"}]\n```', "Hello there"]


def scripted(spark, d):
    """conv_id and five scripted responses, dealt out by arithmetic."""
    pick = lambda i: F.get(F.array(*map(F.lit, SCRIPT)), ((F.col("conv_id") * 7 + i * (F.col("conv_id") % 4 + 1)) % 5).cast("int"))
    return table(spark, d, "conversations").select("conv_id").distinct().select("conv_id", F.array(*[pick(i) for i in range(5)]).alias("responses"))


_SAID = "said AS (SELECT conv_id, t, (conv_id * 7 + (t - 1) * (conv_id % 4 + 1)) % 5 AS k FROM (SELECT DISTINCT conv_id FROM conversations), range(1, 6) r(t))"


@query(
    "j4_skill_discovery",
    f"""WITH {_SAID}, marks AS (SELECT *, coalesce(bool_or(k = 2) OVER w, false) AS ran FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ends AS (SELECT conv_id, min(t) AS t FROM marks WHERE t = 5 OR (k = 3 AND ran) GROUP BY conv_id)
SELECT e.conv_id, e.t::INTEGER AS turn, bool_or(k = 0) AS listed, bool_or(k = 1) AS viewed, bool_or(k = 2) OR max(k) FILTER (m.t = e.t) <> 3 AS executed,
  CASE WHEN max(k) FILTER (m.t = e.t) = 3 THEN 'answer' ELSE 'tool' END AS outcome FROM ends e JOIN marks m ON m.conv_id = e.conv_id AND m.t <= e.t GROUP BY e.conv_id, e.t""",
)
def _(spark, d):
    state = C.discovery(F.transform("responses", C.kind))
    return scripted(spark, d).select("conv_id", state.alias("s")).select("conv_id", "s.turn", "s.listed", "s.viewed", "s.executed", "s.outcome")


@query(
    "j6_agent_graph",
    f"""WITH {_SAID}, ends AS (SELECT conv_id, coalesce(min(t) FILTER (k > 2), 6) AS t FROM said GROUP BY conv_id)
SELECT e.conv_id, coalesce(string_agg(['list_skills', 'view_skill pii-detection', 'analyze_pii'][k + 1], ',' ORDER BY s.t) FILTER (s.t < e.t), '') AS ran FROM ends e JOIN said s USING (conv_id) GROUP BY e.conv_id""",
)
def _(spark, d):
    return scripted(spark, d).select("conv_id", F.array_join(C.agent(F.transform("responses", text.all_calls)), ",").alias("ran"))


_C0, _C1 = "(conv_id * 7) % 5", "(conv_id * 7 + conv_id % 4 + 1) % 5"


@query("j3_direct_tool", f"SELECT conv_id, CASE WHEN {_C0} = 2 THEN 2 ELSE 1 END AS turns, {_C0} = 2 AS executed, CASE WHEN {_C0} = 2 THEN CASE WHEN {_C1} = 3 THEN 1 ELSE 2 END WHEN {_C0} = 3 THEN 1 ELSE 0 END AS n FROM (SELECT DISTINCT conv_id FROM conversations)")
def _(spark, d):
    out = C.direct_tool(F.col("responses"), F.array(F.lit("a"), F.lit("b")))
    return scripted(spark, d).select("conv_id", out.alias("o")).select("conv_id", "o.*")


# ---- runs, sources and sinks ----


def echo(model: str):
    """A stub model: answers with one detection, fails on batches whose first prompt has an x, and gives nothing for one in ten."""

    def answer(prompts: list) -> list:
        if len(prompts) > 1 and "9" in prompts[0]:
            raise ValueError("batch refused")
        return [None if len(p) % 10 == 0 else f'[{{"type": "PERSON", "start": 8, "end": {8 + len(model)}}}]' for p in prompts]

    return answer


@query("j2_batched_run", f"WITH {CARDS_SQL}, p AS (SELECT key, 'Q: ' || text AS prompt FROM cards), g AS (SELECT p.*, m.m FROM p, (VALUES ('m0'), ('m1')) m(m)) SELECT m AS model, count(*) AS n, count(*) FILTER (length(prompt) % 10 = 0) AS errors, count(*) FILTER (length(prompt) % 10 <> 0) AS answers FROM g GROUP BY m")
def _(spark, d):
    out = runner.Runner(runner.Config(["m0", "m1"], {"zero_shot": "Q: {text}"}), echo).run(cards(spark, d).drop("gold0"))
    return out.groupBy("model").agg(F.count("*").alias("n"), F.count_if(F.col("error") != "").alias("errors"), F.sum(F.size("preds")).alias("answers"))


@query("j8_grid", f"WITH {CARDS_SQL} SELECT m.m AS model, c.c AS condition, count(*) AS n FROM cards, (VALUES ('m0'), ('m1'), ('m2')) m(m), (VALUES ('zero_shot'), ('cot')) c(c) GROUP BY ALL")
def _(spark, d):
    return runner.prompts(cards(spark, d).select("key", "text"), {"zero_shot": "{text}", "cot": "Think. {text}"}, ["m0", "m1", "m2"]).groupBy("model", "condition").agg(F.count("*").alias("n"))


@query("j10_offline_scorer", f"WITH {RECORDS_SQL} SELECT model, condition, sum(CASE WHEN key % 5 = 3 THEN 0 ELSE len(preds) END)::BIGINT AS n_pred, sum(len(gold))::BIGINT AS n_gold FROM records GROUP BY ALL")
def _(spark, d):
    own = responses(spark, d).drop("preds").withColumnRenamed("response", "raw_response")
    scored = match.scored(runner.answered(own), (("type", "full", "f1"),))
    return scored.groupBy("model", "condition").agg(F.sum("n_pred").alias("n_pred"), F.sum("n_gold").alias("n_gold"))


@query("j10_offline_scores", f"WITH {scored_sql([('type', 'full', 'ft')])} SELECT model, condition, round(avg(CASE WHEN key % 5 = 3 THEN 0 ELSE ft END), 6) AS f1, round(avg(CASE WHEN key % 5 = 3 THEN 0 ELSE r_ft END), 6) AS recall FROM scored GROUP BY ALL")
def _(spark, d):
    own = responses(spark, d).drop("preds").withColumnRenamed("response", "raw_response")
    scored = match.scored(runner.answered(own), (("type", "full", "f1+"),))
    return scored.groupBy("model", "condition").agg(r6(F.avg("f1")).alias("f1"), r6(F.avg("r_f1")).alias("recall"))


@query("a13_run_sink", f"WITH {RECORDS_SQL} SELECT model, condition, 'main' AS run_type, count(*) AS n, sum(len(preds))::BIGINT AS preds, count(*) FILTER (error = '') AS clean FROM records WHERE model IN ('m0', 'm1') GROUP BY ALL")
def _(spark, d):
    path = shared_dir(spark) + "/runs"
    results.write_run(records(spark, d).filter(F.col("model").isin("m0", "m1")), path, "main", "v1")
    back = results.with_spans(results.read_run(spark, path), "predictions")
    return back.groupBy("model", "condition", "run_type").agg(F.count("*").alias("n"), F.sum(F.size("predictions")).alias("preds"), F.count_if(F.col("error") == "").alias("clean"))


@query("a12_redacting_sink", f"WITH {RECORDS_SQL} SELECT sum(len(preds))::BIGINT AS spans, sum(len(preds))::BIGINT AS hidden FROM records WHERE model = 'm2'")
def _(spark, d):
    path = shared_dir(spark) + "/runs"
    results.write_run(records(spark, d).filter("model = 'm2'"), path, "pilot", "v1")
    flat = results.with_spans(results.read_run(spark, path), "predictions").select(F.explode("predictions").alias("p"))
    return flat.agg(F.count("*").alias("spans"), F.count_if(F.col("p.text") == "[REDACTED]").alias("hidden"))


@query("a15_benchmark_sink", f"WITH {CORPUS_SQL} SELECT source, count(*) AS n FROM corpus WHERE len(types) > 0 AND len(list_filter({STRICT_SQL}, lambda t: t IS NULL)) = 0 GROUP BY source")
def _(spark, d):
    path = shared_dir(spark) + "/benchmark"
    results.write_benchmark(corpus.compiled(typed(spark, d)), path)
    return spark.read.schema(results.BENCHMARK).parquet(path).groupBy("source").agg(F.count("*").alias("n"))


@query("a2_samples_round_trip", f"WITH {CARDS_SQL} SELECT 's' || key AS id, len(gold) AS n, (list_sum(list_transform(gold, lambda g: g.stop - g.start)))::BIGINT AS chars FROM cards")
def _(spark, d):
    path = shared_dir(spark) + "/samples"
    results.write_samples(cards(spark, d).withColumn("id", F.concat(F.lit("s"), F.col("key"))), path)
    back = results.with_spans(spark.read.schema(results.SAMPLES).json(path), "ground_truth")
    return back.select("id", F.size("ground_truth").cast("long").alias("n"), F.aggregate("ground_truth", F.lit(0), lambda n, g: n + g["stop"] - g["start"]).cast("long").alias("chars"))


@query("a14_uniform_schema", f"WITH {RECORDS_SQL} SELECT count(*) FILTER (key % 4 = 0 OR len(preds) = 0) AS empty_lists, count(*) AS clean_errors FROM records WHERE model = 'm0'")
def _(spark, d):
    own = records(spark, d).filter("model = 'm0'").withColumns({"preds": F.when(F.col("key") % 4 != 0, F.col("preds")), "error": F.lit(None).cast("string")})
    return results.published(own).agg(F.count_if(F.col("predictions") == "[]").alias("empty_lists"), F.count_if(F.col("error") == "").alias("clean_errors"))


@query("a16_samples_builder", f"SELECT source, count(*) AS n FROM (WITH {sample_sql(100, 'documents', f'source || {BIN}', 'doc_id', 'doc_id, source')}) GROUP BY source")
def _(spark, d):
    path = shared_dir(spark) + "/samples"
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    some = corpus.stratified_sample(docs, 100, [F.col("source"), spans.length_bin(F.col("text"))], "doc_id")
    found = F.transform(text.detect(F.col("text")), lambda s: F.struct(s["type"].alias("type"), s["text"].alias("text"), s["start"].alias("start"), s["stop"].alias("stop")))
    results.write_samples(some.withColumns({"id": F.col("doc_id").cast("string"), "gold": found}), path)
    return spark.read.schema(results.SAMPLES).json(path).groupBy("source").agg(F.count("*").alias("n"))


@query("j14_condition_kinds", f"WITH {RECORDS_SQL} SELECT condition, condition NOT IN ('with_tools', 'with_skills') AS single_turn, count(*) AS n FROM records GROUP BY condition")
def _(spark, d):
    return records(spark, d).groupBy("condition").agg(F.count("*").alias("n")).withColumn("single_turn", F.col("condition").isin(*runner.SINGLE_TURN))
