"""Loops of several turns with a live model, as rounds over a frame of open conversations.

In every round all conversations that are still open get their next response, in batches; those that call a tool get its result; the
answer routes each of them to its end or to its next prompt. The rounds of a loop are bounded by its number of turns, not by the number
of conversations. Each round is written to the shared folder: a lost executor repeats a part of one round, and a finished conversation
costs nothing more.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanmill.functions import text
from spanmill.operators import conversation as C
from spanmill.operators.runner import PIECE, Tools, generate
from spanmill.sources.paths import dealt, stored

# What the discovery loop says, and its skill's name and text where there is none.
SKILL = "pii-detection"
NO_SKILL_TEXT = "Call [TOOL_CALL: analyze_pii] to detect PII. Output JSON detections then sanitized text."
SKILLS_ARE = "Skills available: {}. Next: [TOOL_CALL: view_skill pii-detection]"
SKILL_SHOWN = "{}\n\nNow call [TOOL_CALL: analyze_pii] to analyze the text."
TOOL_FAILED = "analyze_pii error: {}. Complete the task without the tool."
TOOL_FOUND = "Detections:\n```json\n{}\n```\n\nSanitized text:\n```\n{}\n```\n\nOutput the JSON array of detections, then the sanitized text."
NUDGE_FIRST_CALL = "You must call analyze_pii before answering. Reply with: [TOOL_CALL: analyze_pii]"
NUDGE = "Reply with exactly: {}"
NUDGE_FINAL = "Output your final answer: JSON array of detections, then sanitized text."
TIMEOUT = "timeout"
NO_TOOL, NO_TEXT = "PII-Codex not available", "No text provided"


class SkillTools:
    """What the loops can call: list_skills, view_skill and analyze_pii. It goes to the workers once, with its documents.

    docs: skill texts by name, as sources.results.read_skills() gives them. Failures are results with an "error".
    """

    def __init__(self, docs: dict[str, str] | None = None, tools: Tools | None = None):
        self.docs, self.tools = dict(docs or {}), tools or Tools()

    @property
    def names(self) -> list[str]:
        return sorted(self.docs) or [SKILL]

    @property
    def analyzes(self) -> bool:
        return "analyze_pii" in self.tools.tools

    def run(self, tool: str, param: str | None = None, body: str | None = None) -> dict:
        names = self.names
        if tool == "list_skills":
            return {"tool": tool, "result": names, "message": "Available skills: " + ", ".join(names)}
        if tool == "view_skill":
            if param in names or param == SKILL:
                return {"tool": tool, "skill": param, "content": self.docs.get(param, NO_SKILL_TEXT), "message": "Skill loaded. Call analyze_pii next."}
            return {"tool": tool, "skill": param, "error": f"Skill '{param}' not found. Available: {', '.join(names)}"}
        if tool == "analyze_pii":
            if not self.analyzes:
                return {"tool": tool, "error": NO_TOOL}
            return {"tool": tool, "error": NO_TEXT} if body is None else self.tools.run(tool, text=body)
        return {"error": f"Unknown tool: {tool}"}

    def said(self, tool: str, result: dict) -> str:
        """The discovery loop's message after a call."""
        if tool == "list_skills":
            return SKILLS_ARE.format(", ".join(result["result"]))
        if tool == "view_skill":
            return SKILL_SHOWN.format(result.get("content", result.get("error", "Not found")))
        if "error" in result:
            return TOOL_FAILED.format(result["error"])
        return TOOL_FOUND.format(json.dumps(result.get("detections", []), indent=2), result.get("sanitized_text_context", result.get("sanitized_text", "")))

    def told(self, call: str, arguments: dict, body: str, allowed: list[str]) -> str:
        """The agent's message after a call: a text, or TOOL_ERROR in place of an exception."""
        if call not in allowed:
            return f"TOOL_ERROR: unknown tool '{call}'"
        takes = {"list_skills": set(), "view_skill": {"skill_name"}, "analyze_pii": {"text"}}[call]
        if odd := [k for k in arguments if k not in takes]:
            return f"TOOL_ERROR(TypeError): {call}() got an unexpected keyword argument '{odd[0]}'"
        try:
            if call == "view_skill":
                shown = self.run(call, arguments.get("skill_name", SKILL))
                return shown.get("content") or shown.get("error") or json.dumps(shown)
            if call == "list_skills":
                return json.dumps(self.run(call))
            if not self.analyzes:
                return json.dumps({"error": NO_TOOL, "detections": []})
            own = arguments.get("text") or ""
            return json.dumps(self.run(call, body=own if own.strip() else body))
        except Exception as e:
            return f"TOOL_ERROR(Exception): {e}"


#: Columns of a loop on its way, and what it adds to the samples in the end.
OWN = ["first", "system", "listed", "viewed", "executed", "open", "seconds", "calls", "turns", "history", "found", "failed"]
RESULT = ["preds", "raw_response", "tool_executed", "skill_viewed", "conversation_turns", "error", "elapsed", "model_calls"]


def _o(name: str) -> Column:
    return F.col(f"__{name}")


def _start(rows: DataFrame) -> DataFrame:
    """rows (model, prompt, ...) as open conversations."""
    zero = {n: F.lit(False) for n in ("listed", "viewed", "executed")} | {"open": F.lit(True), "seconds": F.lit(0.0), "calls": F.lit(0), "turns": F.lit(0)}
    zero |= {"system": F.lit(None).cast("string"), "history": F.concat(F.lit(C.USER), F.coalesce("prompt", F.lit(""))), "found": F.lit("[]"), "failed": F.lit("")}
    return rows.withColumns({"__first": F.coalesce("prompt", F.lit("")), **{f"__{k}": v for k, v in zero.items()}})


def _called(rows: DataFrame, run: Callable[[dict], tuple], added: str) -> DataFrame:
    """rows with what run gives for each of them (strings named in added) and the seconds of it."""
    names = added.split()
    schema = T.StructType([*rows.schema.fields, *[T.StructField(c, T.StringType()) for c in names], T.StructField("__spent", T.DoubleType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PIECE):
                b = whole.slice(at, PIECE)
                out, spent = [], []
                for row in b.to_pylist():
                    began = time.perf_counter()
                    out.append(run(row))
                    spent.append(time.perf_counter() - began)
                new = [pa.array([r[k] for r in out], pa.string()) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([*b.columns, *new, pa.array(spent, pa.float64())], names=schema.names)

    return rows.mapInArrow(task, schema)


#: Spark's rows of a batch that goes to a Python worker, and its default.
BATCH, DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of PIECE rows for what runs meanwhile: conversations are long, and each of a task's workers holds a batch of them."""
    held = spark.conf.get(BATCH, DEFAULT)
    spark.conf.set(BATCH, str(PIECE))
    try:
        yield
    finally:
        spark.conf.set(BATCH, held)


def _rounds(start: DataFrame, step: Callable[[DataFrame, int], DataFrame], limit: int) -> DataFrame:
    """All rows after step has been applied to the open ones until none is left, `limit` times at most."""
    rows, done = stored(dealt(start), "open"), []
    with _small_batches(start.sparkSession):
        for number in range(1, limit + 1):
            live = rows.filter("__open")
            if live.limit(1).count() == 0:
                break
            done.append(rows.filter("not __open"))
            rows = stored(step(live, number), f"round{number}")
    return reduce(DataFrame.unionByName, [*done, rows])


def _result(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The samples' columns and RESULT."""
    items = F.from_json("__found", "array<struct<type:string,text:string,start:string,end:string>>")
    from spanmill.functions import spans

    preds = F.transform(F.coalesce(items, F.array().cast("array<struct<type:string,text:string,start:string,end:string>>")), lambda s: F.struct(s["type"].alias("type"), s["text"].alias("text"), spans.offset(s["start"]).alias("start"), spans.offset(s["end"]).alias("stop")))
    own = [preds, F.when(~_o("failed").isin("", TIMEOUT), None).otherwise(_o("history")), _o("executed"), _o("viewed"), _o("turns").cast("long"), _o("failed"), _o("seconds"), _o("calls").cast("long")]
    return rows.select(*[F.col(f"`{c}`") for c in columns if c not in RESULT], *[c.alias(n) for c, n in zip(own, RESULT, strict=True)])


def _items(response: Column) -> Column:
    return F.to_json(text.answer(F.coalesce(response, F.lit(""))))


def discover(samples: DataFrame, make: Callable[[str], Callable[[list], list]], tools: SkillTools, max_turns: int = 5, max_seconds: float | None = None, batch: int = 12, body: str = "text") -> DataFrame:
    """The skill-discovery loop over samples (model, prompt, text, ...): samples with RESULT.

    A conversation sees its first prompt and the latest system message only. It ends with an answer once analyze_pii was called, at the
    last turn, with a model's failure, or when more than max_seconds were spent, which is looked at before and after each response
    (error "timeout", no predictions). At the last turn the tool's detections stand in for a missing answer; then the tool counts as
    executed only if it found something.
    """
    columns = samples.columns

    def analyse(row: dict) -> tuple:
        if not row["__need"]:
            return (None,)
        return (json.dumps(tools.run("analyze_pii", body=row[body] if row[body] is not None else "").get("detections", [])),)

    def call(row: dict) -> tuple:
        if row["__tool"] is None:
            return (None,)
        return (tools.said(row["__tool"], tools.run(row["__tool"], row["__param"], row[body] if row[body] is not None else "")),)

    def step(rows: DataFrame, number: int) -> DataFrame:
        over = (lambda: _o("seconds") > max_seconds) if max_seconds else (lambda: F.lit(False))
        last = number >= max_turns
        asked = rows.withColumns({"prompt": C.with_system(_o("first"), _o("system")), "__turns": F.lit(number), "__calls": _o("calls") + 1}).drop("__system")
        got = generate(asked, make, batch)
        r = F.coalesce("raw_response", F.lit(""))
        got = got.withColumns({"__seconds": _o("seconds") + F.col("elapsed"), "__failed": F.col("error")})
        got = got.withColumns({"__failed": F.when((_o("failed") == "") & over(), TIMEOUT).otherwise(_o("failed"))})
        got = got.withColumns({"__history": F.concat("__history", F.lit("\n\n[assistant]\n"), r), "__say": text.tool_call(r)})
        fine = _o("failed") == ""
        tool = F.coalesce(F.col("__say.tool"), F.when(text.asks_to_analyze(r), "analyze_pii"))
        got = got.withColumns({"__tool": F.when(fine, tool), "__param": F.col("__say.param")}).drop("__say")
        got = _called(got, call, "__system").withColumn("__seconds", _o("seconds") + F.col("__spent")).drop("__spent")
        kind = F.col("__tool")
        got = got.withColumns({"__listed": _o("listed") | F.coalesce(kind == "list_skills", F.lit(False)), "__viewed": _o("viewed") | F.coalesce(kind == "view_skill", F.lit(False)), "__executed": _o("executed") | F.coalesce(kind == "analyze_pii", F.lit(False))})
        # at the last turn the latest message is read as the answer, whoever said it
        items = F.when(fine, _items(F.coalesce("__system", r) if last else F.when(kind.isNull(), r)))
        got = got.withColumn("__items", F.coalesce(items, F.lit("[]")))
        some = F.col("__items") != "[]"
        if last:
            got = _called(got.withColumn("__need", fine & ~some & F.lit(tools.analyzes)), analyse, "__more").withColumn("__seconds", _o("seconds") + F.col("__spent")).drop("__spent")
            more = F.coalesce("__more", F.lit("[]"))
            end = {"__open": F.lit(False), "__found": F.when(some, F.col("__items")).otherwise(more), "__executed": _o("executed") | (more != "[]")}
            extra = F.when(kind.isNotNull(), F.concat(F.lit(C.SYSTEM), F.col("__system"))).otherwise("")
            got = got.withColumns({**end, "__history": F.concat("__history", extra)}).drop("__need", "__more")
        else:
            ends = ~fine | (kind.isNull() & some & _o("executed"))
            nudge = (
                F.when(some & ~_o("executed"), NUDGE_FIRST_CALL).when(~_o("listed"), NUDGE.format(C.CALL_LIST)).when(~_o("viewed"), NUDGE.format(C.CALL_VIEW))
                .when(~_o("executed"), NUDGE.format(C.CALL_ANALYZE)).otherwise(NUDGE_FINAL)
            )
            got = got.withColumns({"__system": F.coalesce("__system", nudge), "__open": ~ends, "__found": F.when(ends & fine, F.col("__items")).otherwise("[]")})
            got = got.withColumn("__history", F.when(_o("open"), F.concat("__history", F.lit(C.SYSTEM), F.col("__system"))).otherwise(_o("history")))
            # the time is looked at before the next response too, which then counts as a turn
            late = _o("open") & over()
            got = got.withColumns({"__failed": F.when(late, TIMEOUT).otherwise(_o("failed")), "__turns": _o("turns") + late.cast("int"), "__open": _o("open") & ~late})
        return got.select(*[F.col(f"`{c}`") for c in rows.columns])

    return _result(_rounds(_start(samples), step, max_turns), columns)


def ask_tool(samples: DataFrame, make: Callable[[str], Callable[[list], list]], tools: SkillTools, batch: int = 12, body: str = "text") -> DataFrame:
    """The direct loop over samples (model, prompt, text, ...): samples with RESULT. A response that asks for analyze_pii gets its
    result and answers once more; the tool's detections stand in for a missing answer."""
    columns = samples.columns

    def call(row: dict) -> tuple:
        if not row["__asks"]:
            return None, None
        result = tools.run("analyze_pii", body=row[body] if row[body] is not None else "")
        return json.dumps(result, indent=2), json.dumps(result.get("detections", []))

    def step(rows: DataFrame, number: int) -> DataFrame:
        rows = rows.withColumn("__then", _o("then") if number > 1 else F.lit(None).cast("string"))
        prompt = _o("first") if number == 1 else F.concat(F.lit(C.ANALYZED), _o("system"), F.lit(C.FORMAT_NOW))
        got = generate(rows.withColumns({"prompt": prompt, "__turns": F.lit(number), "__calls": _o("calls") + 1}), make, batch)
        r = F.coalesce("raw_response", F.lit(""))
        got = got.withColumns({"__seconds": _o("seconds") + F.col("elapsed"), "__failed": F.col("error")})
        fine = _o("failed") == ""
        if number == 1:
            got = _called(got.drop("__system", "__found").withColumn("__asks", fine & text.asks_to_analyze(r) & F.lit(tools.analyzes)), call, "__system __found")
            own = {"__open": F.col("__asks"), "__executed": F.col("__asks"), "__found": F.when(F.col("__asks"), _o("found")).otherwise(F.when(fine, _items(r)).otherwise("[]"))}
            return got.withColumns({**own, "__history": r, "__seconds": _o("seconds") + F.col("__spent")}).select(*rows.columns)
        items = _items(r)
        found = F.when(~fine, "[]").when(items != "[]", items).otherwise(_o("found"))
        shown = F.concat(F.lit("[Turn 1]\n"), _o("history"), F.lit("\n\n[Turn 2]\n"), r)
        return got.withColumns({"__open": F.lit(False), "__found": found, "__history": shown, "__executed": fine}).select(*rows.columns)

    start = _start(samples).withColumn("__then", F.lit(None).cast("string"))
    return _result(_rounds(start, step, 2), columns)


#: Tools by condition; the others call none.
CONDITION_TOOLS = {"with_tools": ["analyze_pii"], "with_skills": ["list_skills", "view_skill", "analyze_pii"]}
MESSAGES = "array<struct<role:string,name:string,content:string>>"
# The agent's system message.
AGENT_SYSTEM = "You are an agent. Be precise and follow provided instructions.\nIf tools are available and needed, call them.\n"
SKILL_BLOCK = "\n=== SKILL PACK ===\n{}\n==================\n"
DOCS_BLOCK = "\n=== REFERENCES (retrieved) ===\n{}\n==============================\n"


def agent_system(condition: str, skill: str = "", docs: list[str] | None = None, k: int = 4) -> str:
    """The system message of a condition: with the skill text, with documents, with both or with neither."""
    pack = SKILL_BLOCK.format(skill.strip()) if condition == "with_skills" and skill.strip() else ""
    shown = "\n\n".join((docs or [])[: max(1, k)]).strip()
    return AGENT_SYSTEM + pack + (DOCS_BLOCK.format(shown) if condition in ("with_docs", "with_skills") and shown else "")


def converse(samples: DataFrame, make: Callable[[str], Callable[[list], list]], tools: SkillTools, max_steps: int = 5, batch: int = 12, body: str = "text", native: tuple = (), docs: list[str] | None = None) -> DataFrame:
    """The agent over samples (model, condition, prompt, text, ...): samples with RESULT; turns count the model's messages.

    The tools of the condition are offered. A response's bracket calls all run, in order; without any, its structured or spoken call
    does. After max_steps calls no more are looked for, and the last response is the answer. Models in `native` get all messages as
    JSON, the others one follow-up prompt. A tool's failure is a message; a model's failure ends the conversation.
    """
    columns = samples.columns

    def call(row: dict) -> tuple:
        own, allowed = [], CONDITION_TOOLS.get(row["condition"], [])
        for c in json.loads(row["__queue"]):
            name, arguments = c["name"], json.loads(c["arguments"] or "{}")
            own.append({"role": "tool", "name": name, "content": tools.told(name, arguments, row[body] or "", allowed)})
        return (json.dumps(own),)

    item = "array<struct<name:string,arguments:string>>"

    def step(rows: DataFrame, number: int) -> DataFrame:
        tail = F.transform(F.filter(F.slice("__messages", F.greatest(F.lit(1), F.size("__messages") - _o("queued") + 1), F.greatest(F.lit(0), _o("queued"))), lambda m: m["role"] == "tool"), lambda m: F.struct(m["name"].alias("name"), m["content"].alias("content")))
        flat = C.follow_up(_o("first"), tail, F.lit(None).cast("string"))
        asked = rows.withColumns({"prompt": F.when(F.col("model").isin(*native), F.to_json("__messages")).otherwise(flat) if native else flat, "__calls": _o("calls") + 1, "__turns": _o("turns") + 1})
        kept = asked.withColumn("__text", F.to_json("__messages")).drop("__messages")  # nested values do not pass the model's workers
        got = generate(kept, make, batch).withColumn("__messages", F.from_json("__text", MESSAGES)).drop("__text")
        r = F.coalesce("raw_response", F.lit(""))
        got = got.withColumns({"__seconds": _o("seconds") + F.col("elapsed"), "__failed": F.col("error")})
        fine = _o("failed") == ""
        many = F.transform(text.all_calls(r), lambda c: F.struct(F.element_at(F.split(c, " "), 1).alias("name"), F.when(F.size(F.split(c, " ")) > 1, F.to_json(F.struct(F.get(F.split(c, " "), 1).alias("skill_name")))).otherwise("{}").alias("arguments")))
        single = text.structured_call(r)
        one = F.when(single["tool"].isNotNull(), F.array(F.struct(single["tool"].alias("name"), single["arguments"].alias("arguments")))).otherwise(F.array().cast(item))
        allowed = fine & F.col("condition").isin(*CONDITION_TOOLS) & (_o("steps") < max_steps)
        calls = F.when(allowed, F.when(F.size(many) > 0, many.cast(item)).otherwise(one)).otherwise(F.array().cast(item))
        got = got.withColumn("__queue_items", calls)
        runs = F.size("__queue_items") > 0
        got = got.withColumns({"__said": F.when(runs, text.until_first_call(r)).otherwise(r), "__queue": F.to_json("__queue_items"), "__open": runs})
        named = F.transform("__queue_items", lambda c: c["name"])
        got = got.withColumns({"__steps": _o("steps") + F.size(named), "__queued": F.size(named), "__executed": _o("executed") | F.array_contains(named, "analyze_pii"), "__viewed": _o("viewed") | ((F.col("condition") == "with_skills") & F.array_contains(named, "view_skill"))})
        # only rows with calls have work in the workers; the others pass
        got = got.withColumn("__text", F.to_json("__messages")).drop("__messages", "__queue_items")
        got = _called(got, call, "__told").withColumn("__seconds", _o("seconds") + F.col("__spent"))
        said = F.array(F.struct(F.lit("assistant").alias("role"), F.lit(None).cast("string").alias("name"), F.col("__said").alias("content")))
        got = got.withColumn("__messages", F.concat(F.from_json("__text", MESSAGES), said, F.from_json("__told", MESSAGES)))
        final = F.trim(F.col("__said"))
        got = got.withColumns({"__history": F.when(_o("open"), _o("history")).otherwise(final), "__found": F.when(_o("open") | ~fine, "[]").otherwise(_items(final))})
        return got.select(*[F.col(f"`{c}`") for c in rows.columns])

    skill = tools.docs.get(SKILL, NO_SKILL_TEXT)
    system = F.lit(agent_system("zero_shot"))
    for condition in ("with_docs", "with_skills"):
        system = F.when(F.col("condition") == condition, agent_system(condition, skill, docs)).otherwise(system)
    first = F.array(*[F.struct(F.lit(role).alias("role"), F.lit(None).cast("string").alias("name"), c.alias("content")) for role, c in (("system", system), ("user", F.coalesce("prompt", F.lit(""))))])
    start = _start(samples).withColumns({"__messages": first.cast(MESSAGES), "__steps": F.lit(0), "__queued": F.lit(0)})
    return _result(_rounds(start, step, max_steps + 1), columns)
