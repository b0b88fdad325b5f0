"""Queries of live runs: loops of several turns and grids with a commit log. Models are scripted by the conversation's number."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanmill.operators import grid, rounds, runner
from spanmill.plans.fixtures import CARDS_SQL, cards, table
from spanmill.plans.registry import query
from spanmill.plans.text_queries import SCRIPT
from spanmill.sources.paths import shared_dir


def by_script(seconds: bool = False):
    """make() of models that answer with SCRIPT, dealt out by arithmetic as in the replayed loops; replies take 1 to 4 seconds."""

    def make(model: str):
        def answer(rows: list) -> list:
            said = [SCRIPT[(r["conv_id"] * 7 + (r["__calls"] - 1) * (r["conv_id"] % 4 + 1)) % 5] for r in rows]
            return [runner.Reply(s, r["conv_id"] % 4 + 1.0) for s, r in zip(said, rows, strict=True)] if seconds else said

        answer.takes_rows = True
        return answer

    return make


def found_by_length(text: str) -> dict:
    """A tool that finds as many spans as the length of the text modulo 3."""
    found = [{"type": "URL", "text": "x", "start": i, "end": i + 1} for i in range(len(text) % 3)]
    return {"detections": found, "sanitized_text": text}


TOOLS = rounds.SkillTools({"pii-detection": "# pii-detection\nCall analyze_pii."}, runner.Tools(analyze_pii=found_by_length))


def open_conversations(spark, d):
    """conv_id, model, condition, prompt and text (the first turn's) of every conversation."""
    first = table(spark, d, "conversations").groupBy("conv_id").agg(F.coalesce(F.min_by("text", "turn"), F.lit("")).alias("text"))
    condition = F.element_at(F.array(*map(F.lit, ["with_skills", "with_tools", "zero_shot"])), (F.col("conv_id") % 3 + 1).cast("int"))
    return first.withColumns({"model": F.concat(F.lit("m"), F.col("conv_id") % 2), "condition": condition, "prompt": F.concat(F.lit("Find: "), F.col("text"))})


def told(out):
    return out.select("conv_id", "conversation_turns", "tool_executed", "skill_viewed", F.size("preds").cast("long").alias("n_preds"), "error", "model_calls")


#: Conversations with the kinds k of their scripted responses (0 list, 1 view, 2 analyze, 3 answer, 4 none) at turns 1 to 6; nd: what the tool finds.
SCRIPTED_SQL = """ids AS (SELECT conv_id, length(coalesce(arg_min(text, turn), '')) % 3 AS nd FROM conversations GROUP BY conv_id),
said AS (SELECT conv_id, nd, t, (conv_id * 7 + (t - 1) * (conv_id % 4 + 1)) % 5 AS k FROM ids, range(1, 7) r(t))"""


def _discovery_sql(limit: str) -> str:
    """The discovery loop; limit: whether a conversation has run out of time after turn t."""
    return f"""WITH {SCRIPTED_SQL},
marks AS (SELECT *, coalesce(bool_or(k = 2) OVER w, false) AS ran, {limit} AS late FROM said WHERE t <= 5 WINDOW w AS (PARTITION BY conv_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ends AS (SELECT conv_id, min(t) AS t FROM marks WHERE late OR t = 5 OR (k = 3 AND ran) GROUP BY conv_id),
flags AS (SELECT e.conv_id, e.t, bool_or(k = 2 AND NOT late) AS ran, bool_or(k = 1 AND NOT late) AS viewed, bool_or(late) AS late FROM ends e JOIN marks m ON m.conv_id = e.conv_id AND m.t <= e.t GROUP BY ALL)
SELECT f.conv_id, f.t AS conversation_turns, f.ran OR (NOT f.late AND f.t = 5 AND s.k <> 3 AND nd > 0) AS tool_executed, f.viewed AS skill_viewed,
  CASE WHEN f.late THEN 0 WHEN s.k = 3 THEN 1 ELSE nd END AS n_preds, CASE WHEN f.late THEN 'timeout' ELSE '' END AS error, f.t AS model_calls
FROM flags f JOIN said s ON s.conv_id = f.conv_id AND s.t = f.t"""


@query("j4_live_discovery", _discovery_sql("false"))
def _(spark, d):
    return told(rounds.discover(open_conversations(spark, d), by_script(), TOOLS))


@query("j4_time_limit", _discovery_sql("t * (conv_id % 4 + 1) > 9.5"))
def _(spark, d):
    return told(rounds.discover(open_conversations(spark, d), by_script(seconds=True), TOOLS, max_seconds=9.5))


@query(
    "j3_live_direct",
    f"""WITH {SCRIPTED_SQL} SELECT conv_id, CASE WHEN a.k = 2 THEN 2 ELSE 1 END AS conversation_turns, a.k = 2 AS tool_executed, false AS skill_viewed,
  CASE WHEN a.k = 2 THEN CASE WHEN b.k = 3 THEN 1 ELSE a.nd END WHEN a.k = 3 THEN 1 ELSE 0 END AS n_preds, '' AS error, CASE WHEN a.k = 2 THEN 2 ELSE 1 END AS model_calls
FROM (SELECT * FROM said WHERE t = 1) a JOIN (SELECT conv_id, k FROM said WHERE t = 2) b USING (conv_id)""",
)
def _(spark, d):
    return told(rounds.ask_tool(open_conversations(spark, d), by_script(), TOOLS))


@query(
    "j7_live_agent",
    f"""WITH {SCRIPTED_SQL}, ends AS (SELECT conv_id, min(t) AS t FROM said WHERE conv_id % 3 = 2 OR k > 2 OR t = 6 GROUP BY conv_id),
ran AS (SELECT e.conv_id, e.t, bool_or(k = 2 AND s.t < e.t) AS ran, bool_or(k = 1 AND s.t < e.t AND e.conv_id % 3 = 0) AS viewed, max(k) FILTER (s.t = e.t) AS k FROM ends e JOIN said s ON s.conv_id = e.conv_id AND s.t <= e.t GROUP BY ALL)
SELECT conv_id, t AS conversation_turns, ran AS tool_executed, viewed AS skill_viewed, (k = 3)::INTEGER AS n_preds, '' AS error, t AS model_calls FROM ran""",
)
def _(spark, d):
    return told(rounds.converse(open_conversations(spark, d), by_script(), TOOLS))


@query(
    "j5_skill_tools",
    """SELECT conv_id, CASE conv_id % 4 WHEN 0 THEN 'list_skills' WHEN 1 THEN 'view_skill' WHEN 2 THEN 'analyze_pii' ELSE 'other' END AS tool,
  CASE WHEN conv_id % 4 = 1 AND conv_id % 8 <> 1 THEN 'Skill ''none'' not found. Available: pii-detection' WHEN conv_id % 4 = 3 THEN 'Unknown tool: other' END AS error,
  CASE WHEN conv_id % 4 = 2 THEN length(coalesce(arg_min(text, turn), '')) % 3 END AS n_found FROM conversations GROUP BY conv_id""",
)
def _(spark, d):
    import json

    def call(row: dict) -> tuple:
        return (json.dumps(TOOLS.run(row["tool"], "pii-detection" if row["conv_id"] % 8 == 1 else "none", row["text"])),)

    tool = F.element_at(F.array(*map(F.lit, ["list_skills", "view_skill", "analyze_pii", "other"])), (F.col("conv_id") % 4 + 1).cast("int"))
    out = rounds._called(open_conversations(spark, d).withColumn("tool", tool), call, "result")
    found = F.json_array_length(F.get_json_object("result", "$.detections")).cast("long")
    return out.select("conv_id", "tool", F.get_json_object("result", "$.error").alias("error"), found.alias("n_found"))


# ---- grid runs ----


def obedient(model: str):
    """A model that calls what it is told to call and then answers; it has no reply to prompts whose length ends in 0."""

    def answer(prompts: list) -> list:
        out = []
        for p in prompts:
            if p.startswith("You called the analyze_pii"):
                out.append('[{"type": "PERSON", "start": 8, "end": 9}, {"type": "URL"}]')
            elif "must be exactly: " in p:
                out.append(p.rsplit("must be exactly: ", 1)[1])
            elif p.startswith("Agent: "):
                out.append("[TOOL_CALL: list_skills]")
            else:
                out.append(None if len(p) % 10 == 0 else f'[{{"type": "PERSON", "start": 8, "end": {8 + len(model)}}}]')
        return out

    return answer


class Killed(RuntimeError):
    pass


@query(
    "j8_grid_resume",
    f"""WITH {CARDS_SQL}, cells AS (SELECT m.m AS model, c.c AS condition, row_number() OVER (ORDER BY m.m, c.i) AS place FROM (VALUES ('m0'), ('m1')) m(m), (VALUES (0, 'zero_shot'), (1, 'with_skills'), (2, 'cot')) c(i, c)),
runs AS (SELECT model, condition, place, text, length(CASE WHEN condition = 'cot' THEN 'Think. ' || text ELSE text END) % 10 = 0 AND condition <> 'with_skills' AS failed FROM cards, cells)
SELECT model, condition, count(*) AS n, count(*) FILTER (failed) AS errors, (sum(CASE WHEN condition = 'with_skills' THEN 2 WHEN failed THEN 0 ELSE 1 END))::BIGINT AS preds,
  count(*) FILTER (condition = 'with_skills') AS tool_calls, sum(CASE WHEN condition = 'with_skills' THEN 4 ELSE 1 END)::BIGINT AS turns, CASE WHEN place <= 2 THEN 1 ELSE 2 END AS run FROM runs GROUP BY model, condition, place""",
)
def _(spark, d):
    """Killed after two of six groups, then resumed: the second run does the rest."""
    config = runner.Config(["m0", "m1"], {"zero_shot": "{text}", "with_skills": "Agent: {text}", "cot": "Think. {text}"})
    own = grid.Grid(config, obedient, shared_dir(spark) + "/grid", TOOLS)
    samples = cards(spark, d).drop("gold0")
    done: list[tuple] = []

    def committed(model: str, condition: str) -> None:
        done.append((model, condition))
        if len(done) == 2:
            raise Killed

    try:
        own.run(samples, committed=committed)
    except Killed:
        first = len(done)
    records = own.run(samples, committed=committed)
    place = F.create_map(*[x for i, (m, c) in enumerate(done) for x in (F.lit(f"{m} {c}"), F.lit(1 if i < first else 2))])
    sums = [F.count(F.lit(1)).alias("n"), F.count_if(F.col("error") != "").alias("errors"), F.sum(F.size("preds")).alias("preds"), F.count_if("tool").alias("tool_calls"), F.sum("turns").alias("turns")]
    return records.groupBy("model", "condition").agg(*sums).withColumn("run", place[F.concat_ws(" ", "model", "condition")])


@query(
    "j8_grid_summary",
    f"""WITH {CARDS_SQL} SELECT m.m AS model, c.c AS condition, count(*) AS n, count(*) FILTER (length(text) % 10 = 0) AS errors, 0::BIGINT AS tool_calls
FROM cards, (VALUES ('m0'), ('m1')) m(m), (VALUES ('zero_shot'), ('few_shot')) c(c) GROUP BY ALL""",
)
def _(spark, d):
    config = runner.Config(["m0", "m1"], {"zero_shot": "{text}", "few_shot": "{text}"})
    own = grid.Grid(config, obedient, shared_dir(spark) + "/grid")
    own.run(cards(spark, d).drop("gold0"))
    return own.summary(spark).drop("total_seconds", "mean_seconds")


def hook_by_length(model, sample: dict, prompt: str, flags: dict) -> dict:
    """A runner hook that asks the model, raises for keys divisible by 7, and counts a tool call where tools are offered."""
    if sample["key"] % 7 == 0:
        raise ValueError("refused")
    return {"raw_response": model([prompt])[0], "tool_executed": flags["with_tools"], "conversation_turns": 2}


@query(
    "m_runner_hook",
    f"""WITH {CARDS_SQL} SELECT c.c AS condition, count(*) AS n, count(*) FILTER (key % 7 = 0) AS errors, count(*) FILTER (key % 7 <> 0 AND c.c = 'with_tools') AS tool_calls,
  count(*) FILTER (key % 7 <> 0 AND length(text) % 10 <> 0) AS preds FROM cards, (VALUES ('zero_shot'), ('with_tools')) c(c) GROUP BY ALL""",
)
def _(spark, d):
    config = runner.Config(["m0"], {"zero_shot": "{text}", "with_tools": "{text}"})
    own = grid.Grid(config, obedient, shared_dir(spark) + "/grid", hook=hook_by_length)
    out = own.run(cards(spark, d).drop("gold0"))
    return out.groupBy("condition").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("error") == "refused").alias("errors"), F.count_if("tool").alias("tool_calls"), F.sum(F.size("preds")).alias("preds"))
