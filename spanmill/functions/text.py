"""Reading model output: JSON answers, tool calls, and regular-expression detectors with exact offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanmill.functions import spans

# Where an answer is looked for, in order: marks to its left and right, and whether they belong to it.
ANSWER = [("```json", "```", False), ("```", "```", False), ("[", "]", True)]

# Bracket calls alone on a line, and anywhere.
LINE_LIST = r"(?im)^[ \t\r]*\[TOOL_CALL:\s*list_skills\s*\]\.?[ \t\r]*$"
LINE_ANALYZE = r"(?im)^[ \t\r]*\[TOOL_CALL:\s*analyze_pii\s*\]\.?[ \t\r]*$"
LINE_VIEW = r"(?im)^[ \t\r]*\[TOOL_CALL:\s*view_skill\s+(\w+(?:-\w+)?)\s*\]\.?[ \t\r]*$"
LINE_ANY = r"(?im)^[ \t\r]*\[TOOL_CALL:\s*(list_skills|analyze_pii|view_skill\s+\w+(?:-\w+)?)\s*\]\.?[ \t\r]*$"
CALL_LIST = r"(?i)\[TOOL_CALL\s*:\s*list_skills\s*\]"
CALL_VIEW = r"(?i)\[TOOL_CALL\s*:\s*view_skill\s+(\w+(?:-\w+)?)\s*\]"
CALL_ANALYZE = r"(?i)\[TOOL_CALL\s*:\s*analyze_pii\s*\]"
CALL_ANY = r"(?i)\[TOOL_CALL\s*:\s*(list_skills|view_skill\s+\w+(?:-\w+)?|analyze_pii)\s*\]"

# Phrases that stand for a call.
SAY_LIST = (
    r"(?i)\blist_skills\b|list_skills\s*\(|list\s+skills|call\s+list_skills|I will\s+list|listing\s+skills|I'll\s+list\s+skills|I\s+will\s+list\s+skills"
    r"|here\s+is\s+.*list_skills|to\s+list\s+skills|use\s+list_skills|reply\s+with\s+.*list_skills|output\s+.*\[TOOL_CALL"
)
SAY_VIEW = r"""(?i)view_skill\s*\(\s*["']?(\w+(?:-\w+)?)["']?\s*\)|view\s+(?:the\s+)?(?:skill\s+)?["']?(pii-detection|\w+)["']?|view_skill\s+(pii-detection|\w+)"""
SAY_VIEW_ANY = r"(?i)view_skill|view\s+the\s+skill|view\s+pii-detection"
SAY_ANALYZE = (
    r"(?i)analyze_pii\s*\(\)|I will use.*analyze_pii|calling.*analyze_pii|use the analyze_pii tool|call\s+analyze_pii|invoke\s+analyze_pii"
    r"|run\s+analyze_pii|I need to.*analyze_pii|let me.*analyze_pii|will call.*analyze_pii|to get (?:the )?(?:detections|sanitized).*analyze_pii"
    r"|\banalyze_pii\b|execute\s+analyze_pii|running\s+analyze_pii|use the (?:pii )?detection tool|run the (?:pii )?detection tool"
    r"|execute the (?:pii )?detection tool|analyze the text|I will (?:use|run|call) the (?:pii |detection )?tool"
)
ANALYZE = (
    r"(?i)\[TOOL_CALL:\s*analyze_pii\]|\[TOOL_CALL\].*analyze_pii|```tool_call\s*\n?\s*analyze_pii|analyze_pii\s*\(\)|\banalyze_pii\b|I will use.*analyze_pii"
    r"|calling.*analyze_pii|use the analyze_pii tool|call\s+analyze_pii|invoke\s+analyze_pii|run\s+analyze_pii|I need to.*analyze_pii|let me.*analyze_pii"
    r"|will call.*analyze_pii|to get (?:the )?(?:detections|sanitized).*analyze_pii|use the (?:pii )?detection tool|run the (?:pii )?detection tool|analyze the text"
)
DEFAULT_SKILL = "pii-detection"
TAGGED = r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>"

#: Detectors, strongest first: a span that overlaps one of an earlier kind is dropped. Confidence in per cent.
DETECTORS = {
    "EMAIL_ADDRESS": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", 95, 3),
    "IP_ADDRESS": (r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", 90, 2),
    "CREDIT_CARD_NUMBER": (r"\b[0-9]{16}\b", 80, 3),
    "PHONE_NUMBER": (r"\b555-[0-9]{4}\b", 75, 2),
    "PASSWORD": (r"\b[0-9a-f]{32,64}\b", 70, 3),
}
FOUND = "array<struct<start:int,stop:int,type:string,text:string,risk_level:int,confidence:double>>"


def json_list(text: Column) -> Column:
    """The JSON array in text as array<variant>; null where it is no JSON array."""
    return F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")


def with_type(items: Column) -> Column:
    """Those elements of array<variant> that are objects with the key "type", whatever its value."""
    return F.filter(items, lambda v: F.try_variant_get(v, "$.type", "variant").isNotNull())


def read_spans(items: Column) -> Column:
    """Objects of array<variant> as array<struct<type,text,start,stop>> with lenient offsets, read from the variants without JSON text between."""
    own = F.transform(items, lambda v: F.try_variant_get(v, "$", "struct<type:string,text:string,start:string,end:string>"))
    return F.transform(own, lambda s: F.struct(s["type"].alias("type"), s["text"].alias("text"), spans.offset(s["start"]).alias("start"), spans.offset(s["end"]).alias("stop")))


def answer(response: Column) -> Column:
    """The valid items of the first place that holds a JSON array; an empty array if none does."""
    return bound(response, lambda r: F.coalesce(*[with_type(json_list(_between(r, *marks))) for marks in ANSWER], F.array().cast("array<variant>")))


def _between(text: Column, left: str, right: str, whole: bool) -> Column:
    """What is between the first left mark and the next right one, trimmed, or with both marks; null without them.

    Where the first left mark has no right one after it, no later one has: two searches do what a pattern would do step by step.
    """

    def cut(start: Column) -> Column:
        stop = F.nullif(F.position(F.lit(right), text, start), F.lit(0))
        if whole:
            return F.substring(text, start - len(left), stop - start + len(left) + len(right))
        return F.btrim(F.substring(text, start, stop - start), F.lit(" \t\n\v\f\r"))

    return bound(F.nullif(F.instr(text, left), F.lit(0)) + len(left), cut)


def lenient_list(raw: Column) -> Column:
    """A list given as JSON or as a Python literal, as array<variant>; empty where it is neither."""
    python = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.replace(raw, F.lit("'"), F.lit('"')), r"\bNone\b", "null"), r"\bTrue\b", "true"), r"\bFalse\b", "false")
    return F.coalesce(json_list(raw), json_list(python), F.array().cast("array<variant>"))


def _first(text: Column, pattern: str, groups: int) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(text, pattern, i), F.lit("")) for i in range(1, groups + 1)])


def tool_call(response: Column) -> Column:
    """struct<tool, param> of the call a response makes, by line, bracket or phrase; nulls without one."""
    line = F.regexp_extract(response, LINE_ANY, 1)
    first = F.lower(F.regexp_extract(line, r"^(\w+)", 1))
    param = F.nullif(F.regexp_extract(line, r"\s+(\S+)$", 1), F.lit(""))

    def call(tool: Column, arg=None) -> Column:
        return F.struct(tool.cast("string").alias("tool"), (F.lit(None).cast("string") if arg is None else arg).alias("param"))

    lst, view, analyze = F.lit("list_skills"), F.lit("view_skill"), F.lit("analyze_pii")
    return (
        F.when(line != "", call(first, F.when(first == "view_skill", param)))
        .when(response.rlike(CALL_LIST), call(lst))
        .when(response.rlike(CALL_VIEW), call(view, F.regexp_extract(response, CALL_VIEW, 1)))
        .when(response.rlike(CALL_ANALYZE), call(analyze))
        .when(response.rlike(SAY_LIST), call(lst))
        .when(response.rlike(SAY_VIEW), call(view, F.coalesce(_first(response, SAY_VIEW, 3), F.lit(DEFAULT_SKILL))))
        .when(response.rlike(SAY_VIEW_ANY), call(view, F.lit(DEFAULT_SKILL)))
        .when(response.rlike(SAY_ANALYZE), call(analyze))
        .otherwise(call(F.lit(None)))
    )


def asks_to_analyze(response: Column) -> Column:
    return response.rlike(ANALYZE)


def structured_call(response: Column) -> Column:
    """struct<tool, arguments (JSON text)>: a tagged call, else the outermost JSON object, else tool_call()."""
    tagged = F.try_parse_json(F.regexp_extract(response, TAGGED, 1))
    brace = F.try_parse_json(F.regexp_extract(response, r"(?s)(\{.*\})", 1))

    def read(v: Column, *names: str) -> Column:
        args = F.coalesce(*[F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{n}", "variant")).startswith("OBJECT"), F.to_json(F.try_variant_get(v, f"$.{n}", "variant"))) for n in names])
        name = F.try_variant_get(v, "$.name", "string")
        return F.when(name.isNotNull() & args.isNotNull(), F.struct(name.alias("tool"), args.alias("arguments")))

    plain = tool_call(response)
    by_phrase = F.when(plain["tool"].isNotNull(), F.struct(plain["tool"].alias("tool"), F.when(plain["tool"] == "view_skill", F.to_json(F.struct(F.coalesce(plain["param"], F.lit(DEFAULT_SKILL)).alias("skill_name")))).otherwise("{}").alias("arguments")))
    rest = F.coalesce(read(brace, "arguments", "parameters"), by_phrase)
    return F.when(response.rlike(TAGGED) & tagged.isNull(), None).otherwise(F.coalesce(read(tagged, "arguments"), rest))


def all_calls(response: Column) -> Column:
    """array<string> of the bracket calls in order, such as "view_skill x"; blanks made one, names lower-case."""
    calls = F.regexp_extract_all(response, F.lit(CALL_ANY), 1)
    return F.transform(calls, lambda c: F.concat_ws(" ", F.lower(F.element_at(F.split(c, r"\s+"), 1)), F.get(F.split(c, r"\s+"), 1)))


def until_first_call(response: Column) -> Column:
    """The response up to the end of the line of its first bracket call; as it is without one."""
    return F.when(response.rlike(CALL_ANY), F.regexp_extract(response, r"(?is)\A(.*?\[TOOL_CALL\s*:\s*(?:list_skills|view_skill\s+\w+(?:-\w+)?|analyze_pii)\s*\](?:[^\n]*\n)?)", 1)).otherwise(response)


#: Items that a fold gathers at a time.
BLOCK = 256


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once, whatever the number of times that it occurs in use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def prefix_sums(numbers: Column) -> Column:
    """Sums of an array of numbers up to each of them. Folds gather BLOCK items at a time, so that long arrays are not copied item by item."""
    zero = lambda at: F.struct(at.cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
    add = lambda s, x: F.struct((s["at"] + x).alias("at"), F.array_append(s["out"], s["at"] + x).alias("out"))
    late = lambda s, x: F.struct((s["at"] + x).alias("at"), F.array_append(s["out"], s["at"]).alias("out"))

    def blocks(held: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(held) - 1) / BLOCK).cast("int")), lambda k: F.slice(held, k * BLOCK + 1, BLOCK))

    def summed(parts: Column) -> Column:
        starts = F.aggregate(F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda n, x: n + x)), zero(F.lit(0)), late)["out"]
        return F.flatten(F.zip_with(parts, starts, lambda p, at: F.aggregate(p, zero(at), add)["out"]))

    return F.when(F.size(numbers) > 0, bound(numbers, lambda held: bound(blocks(held), summed))).otherwise(F.array().cast("array<bigint>"))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start,stop,text>> of a pattern's matches, without a UDF: running sums over split()."""
    kind = "array<struct<start:int,stop:int,text:string>>"

    def placed(hits: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        sizes = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: (F.length(g) + F.length(h)).cast("long"))
        return F.zip_with(prefix_sums(sizes), hits, lambda z, h: F.struct((z.cast("int") - F.length(h)).alias("start"), z.cast("int").alias("stop"), h.alias("text")))

    found = bound(F.regexp_extract_all(text, F.lit(pattern), 0), placed)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(kind))


def detect(text: Column, kinds: dict | None = None) -> Column:
    """Detections in order of start. Kinds come by priority; overlaps with an earlier kind are dropped."""
    out = F.array().cast(FOUND)
    for name, (pattern, confidence, risk) in (kinds or DETECTORS).items():
        out = F.concat(out, _free(_found(text, name, pattern, confidence, risk), out))
    return F.array_sort(out)


def _found(text: Column, name: str, pattern: str, confidence: int, risk: int) -> Column:
    return F.transform(
        matches(text, pattern),
        lambda m: F.struct(m["start"].alias("start"), m["stop"].alias("stop"), F.lit(name).alias("type"), m["text"].alias("text"), F.lit(risk).alias("risk_level"), F.lit(confidence / 100).alias("confidence")),
    )


def _free(found: Column, taken: Column) -> Column:
    return F.filter(found, lambda m: ~F.exists(taken, lambda o: (o["start"] < m["stop"]) & (m["start"] < o["stop"])))
