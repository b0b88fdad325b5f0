"""Conversations and scripted agents, as folds over arrays of turns: no window over a hot conversation is sorted twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.functions import text

STATE = "struct<turn:int,listed:boolean,viewed:boolean,executed:boolean,done:boolean,outcome:string,last:string>"


def last_message(turns: DataFrame, role: str = "assistant") -> DataFrame:
    """conv_id and the text of the last turn of a role."""
    return turns.filter(F.col("role") == role).groupBy("conv_id").agg(F.max_by("text", "turn").alias("final"))


def trailing_run(turns: DataFrame, role: str = "tool") -> DataFrame:
    """conv_id and the number of turns of a role after the last turn of any other role."""
    last = turns.groupBy("conv_id").agg(F.max(F.when(F.col("role") != role, F.col("turn"))).alias("other"), F.collect_list(F.when(F.col("role") == role, F.col("turn"))).alias("own"))
    return last.select("conv_id", F.size(F.filter("own", lambda t: t > F.coalesce("other", F.lit(-1)))).cast("long").alias("run"))


# What a model is told after a turn.
RESULTS_OF = "You called "
RESULTS_HERE = ". Here are the results:\n\n```json\n"
RESULTS_END = "\n```"
ANALYZED = "You called the analyze_pii tool. Here are the results:\n\n```json\n"
FORMAT_NOW = "\n```\n\nNow format your final answer as a JSON array. Each PII item should have: type, text, start, end.\nOnly output the JSON array, nothing else."
REPLY_EXACTLY = "\n\nYour next reply must be exactly: "
CALL_ANALYZE = "[TOOL_CALL: analyze_pii]"
CALL_VIEW = "[TOOL_CALL: view_skill pii-detection]"
CALL_LIST = "[TOOL_CALL: list_skills]"
USER, SYSTEM = "[user]\n", "\n\n[system]\n"


def follow_up(first_user: Column, tail: Column, last_system: Column) -> Column:
    """The prompt after a turn: tool results if the tail (array<struct<name,content>>) has any, else the
    first prompt with the latest system message."""
    shown = F.array_join(F.transform(tail, lambda m: F.concat(F.lit(RESULTS_OF), m["name"], F.lit(RESULTS_HERE), m["content"], F.lit(RESULTS_END))), "\n\n")
    analysed = F.filter(tail, lambda m: m["name"] == "analyze_pii")
    answer = F.concat(F.lit(ANALYZED), F.get(analysed, F.size(analysed) - 1)["content"], F.lit(FORMAT_NOW))
    viewed = F.exists(tail, lambda m: m["name"] == "view_skill")
    asked = F.concat(shown, F.lit(REPLY_EXACTLY), F.when(viewed, CALL_ANALYZE).otherwise(CALL_VIEW))
    return F.when(F.size(analysed) > 0, answer).when(F.size(tail) > 0, asked).otherwise(with_system(first_user, last_system))


def with_system(first_user: Column, last_system: Column) -> Column:
    """The first prompt, and the latest system message if there is one."""
    return F.when(last_system.isNotNull(), F.concat(F.lit(USER), first_user, F.lit(SYSTEM), last_system)).otherwise(first_user)


def chunks(doc: Column, skill: Column, k: int) -> Column:
    """The first k parts of a document cut at its second-level headings, with the skill text last."""
    parts = F.filter(F.transform(F.split(doc, "\n## "), lambda c: F.trim(c)), lambda c: c != "")
    return F.slice(F.concat(parts, F.when(F.coalesce(skill, F.lit("")) != "", F.array(skill)).otherwise(F.array().cast("array<string>"))), 1, k)


def kind(response: Column) -> Column:
    """list, view, analyze, answer (a JSON array with items) or none."""
    tool = text.tool_call(response)["tool"]
    return (
        F.when(tool == "list_skills", "list")
        .when(tool == "view_skill", "view")
        .when((tool == "analyze_pii") | text.asks_to_analyze(response), "analyze")
        .when(F.size(text.answer(response)) > 0, "answer")
        .otherwise("none")
    )


def discovery(kinds: Column, max_turns: int = 5, has_tool: bool = True) -> Column:
    """The state after replaying the kinds of a conversation's responses through the discovery loop.

    outcome: "answer" (the model's items), "tool" (the tool's detections) or "empty"; last: what the next system
    message asks for. Once done, further responses change nothing; when the turns run out on a tool call, the
    last message is read as the answer, and that of analyze holds detections.
    """
    zero = F.struct(F.lit(0).alias("turn"), *[F.lit(False).alias(n) for n in ("listed", "viewed", "executed", "done")], F.lit("empty").alias("outcome"), F.lit("").alias("last")).cast(STATE)

    def move(s: Column, k: Column) -> Column:
        turn = s["turn"] + 1
        plain = k.isin("answer", "none")
        out = turn >= max_turns
        final = plain & (out | ((k == "answer") & s["executed"]))
        fallback = plain & out & (k != "answer") & F.lit(has_tool)
        spent = ~plain & out  # the budget ends on a tool call
        executed = s["executed"] | (k == "analyze") | fallback | (spent & F.lit(has_tool) & (k != "analyze"))
        outcome = F.when(final & (k == "answer"), "answer").when(fallback | (spent & F.lit(has_tool)), "tool").otherwise("empty")
        ask = (
            F.when(k == "list", "view").when(k == "view", "analyze").when(k == "analyze", "final")
            .when((k == "answer") & ~s["executed"], "analyze").when(~s["listed"], "list").when(~s["viewed"], "view").when(~s["executed"], "analyze").otherwise("final")
        )
        new = F.struct(turn.alias("turn"), (s["listed"] | (k == "list")).alias("listed"), (s["viewed"] | (k == "view")).alias("viewed"), executed.alias("executed"), (final | spent).alias("done"), outcome.alias("outcome"), ask.alias("last"))
        return F.when(s["done"], s).otherwise(new.cast(STATE))

    return F.aggregate(kinds, zero, move)


def agent(calls: Column, max_steps: int = 5) -> Column:
    """Tools run by the agent graph: each response's calls in order, until one has none or max_steps are used.

    calls is array<array<string>>, one entry a response. All calls of a response that was reached are run, so
    the cap can be passed within a response. Returns array<string>.
    """
    zero = F.struct(F.array().cast("array<string>").alias("ran"), F.lit(False).alias("done"))

    def move(s: Column, c: Column) -> Column:
        stop = s["done"] | (F.size(s["ran"]) >= max_steps) | (F.size(c) == 0)
        return F.struct(F.when(stop, s["ran"]).otherwise(F.concat(s["ran"], c)).alias("ran"), stop.alias("done"))

    return F.aggregate(calls, zero, move)["ran"]


def direct_tool(responses: Column, detections: Column) -> Column:
    """The direct loop: struct<turns, executed, n> from the first two responses and the tool's detections."""
    first, second = F.get(responses, F.lit(0)), F.get(responses, F.lit(1))
    asked = text.asks_to_analyze(first)
    final = F.size(text.answer(F.when(asked, second).otherwise(first)))
    n = F.when(asked & (F.coalesce(final, F.lit(0)) == 0), F.size(detections)).otherwise(F.coalesce(final, F.lit(0)))
    return F.struct(F.when(asked, 2).otherwise(1).alias("turns"), asked.alias("executed"), n.alias("n"))
