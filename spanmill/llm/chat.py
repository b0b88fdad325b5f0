r"""Chat formatting by a grammar round trip, with DataFrame functions only.

    conversation := turn*        turn := "### " role ": " text "</turn>\n"

The parser cuts a conversation at "</turn>\n", takes the role up to the first colon that no backslash
precedes, and reads a backslash and a character as that character. A turn is first rendered as it is,
parsed again, and compared with its source. Where it differs, or holds a control string ("###" or
"</turn>"), the content is escaped ("\" to "\\", "###" to "\###", "</turn>" to "<\/turn>", in roles also
":" to "\:") and compared again; after that it has to be identical, or the job fails. The joined conversation is parsed and compared
with all its turns as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.functions.text import bound, prefix_sums

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
TURN = r"(?s)\A### ([^:\\]*(?:\\.[^:\\]*)*): (.*)\z"


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("###"), F.lit("\\###")), F.lit("</turn>"), F.lit("<\\/turn>"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit(":"), F.lit("\\:"))


def unescape(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("\\")), F.regexp_replace(c, r"(?s)\\(.)", "$1")).otherwise(c)


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(MIDDLE), text, F.lit(CLOSE))


def parse(formatted: Column) -> Column:
    """array<struct<role,text,raw,raw_role>> of a formatted conversation; raw is as it stands there."""
    parts = F.split(formatted, F.lit(CLOSE), F.lit(-1))
    turns = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.transform(
        turns,
        lambda t: F.struct(
            unescape(F.regexp_extract(t, TURN, 1)).alias("role"),
            unescape(F.regexp_extract(t, TURN, 2)).alias("text"),
            F.regexp_extract(t, TURN, 2).alias("raw"),
            F.regexp_extract(t, TURN, 1).alias("raw_role"),
        ),
    )


def same(formatted: Column, role: Column, text: Column) -> Column:
    """Whether a rendered turn is read back as exactly this turn."""
    got = parse(formatted)
    return (F.size(got) == 1) & (F.get(got, 0)["role"] == role) & (F.get(got, 0)["text"] == text)


def control(c: Column) -> Column:
    return F.contains(c, F.lit("###")) | F.contains(c, F.lit("</turn>"))


def rendered_turns(rows: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """rows with __role, __text (null: empty) and __turn, the turn as it goes into the conversation."""
    rows = rows.withColumns({"__role": F.coalesce(F.col(role).cast("string"), F.lit("")), "__text": F.coalesce(F.col(text), F.lit(""))})
    plain = render(F.col("__role"), F.col("__text"))
    rows = rows.withColumn("__ok", same(plain, F.col("__role"), F.col("__text")) & ~control(F.col("__role")) & ~control(F.col("__text")))
    safe = render(escape_role(F.col("__role")), escape(F.col("__text")))
    checked = F.when(same(safe, F.col("__role"), F.col("__text")), safe).otherwise(F.raise_error(F.lit("a turn does not survive its round trip")))
    return rows.withColumn("__turn", F.when(F.col("__ok"), plain).otherwise(checked)).drop("__ok")


def format_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """conv, formatted, and loss_spans: array of (start, stop) code points of the loss role's texts in formatted.

    Turns stand in the order of their number, then role and text; repeated rows are repeated turns. Rows without a
    conversation id form one conversation. A conversation is one row by definition, so its turns meet in one
    task; they arrive rendered, each once.
    """
    ready = rendered_turns(rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")))
    turns = ready.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("turn", "__role", "__text", "__turn"))).alias("turns"))
    formatted = turns.withColumn("formatted", F.array_join(F.transform("turns", lambda t: t["__turn"]), ""))
    read = formatted.withColumn("parsed", parse(F.col("formatted")))
    alike = F.transform("parsed", lambda t: F.struct(t["role"].alias("r"), t["text"].alias("t"))) == F.transform("turns", lambda t: F.struct(t["__role"].alias("r"), t["__text"].alias("t")))
    whole = F.when(alike, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not survive its round trip")))
    sizes = F.transform("parsed", lambda t: (F.length(t["raw_role"]) + F.length(t["raw"]) + len(OPEN) + len(MIDDLE) + len(CLOSE)).cast("long"))
    spans = F.zip_with(prefix_sums(sizes), "parsed", lambda end, t: F.struct(t["role"].alias("role"), (end - len(CLOSE) - F.length(t["raw"])).alias("start"), (end - len(CLOSE)).alias("stop")))
    mine = F.transform(F.filter(spans, lambda s: s["role"] == loss_role), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop")))
    return read.select(F.col("conv").alias(conv), whole.alias("formatted"), mine.alias("loss_spans"))


def cut_out(text: Column, spans: Column) -> Column:
    """The pieces of text under spans (start, stop in code points): each costs its own length, as characters have four bytes here."""
    piece = lambda wide, s: F.decode(F.substring(wide, (4 * s["start"] + 1).cast("int"), (4 * (s["stop"] - s["start"])).cast("int")), "UTF-32")
    return bound(F.encode(text, "UTF-32"), lambda wide: F.transform(spans, lambda s: piece(wide, s)))


def digest(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """The contract's columns, all read back from formatted and loss_spans."""
    read = formatted.withColumn("parsed", parse(F.col("formatted")))
    masked = F.array_join(F.transform(cut_out(F.col("formatted"), F.col("loss_spans")), unescape), "")
    read = read.withColumn("__loss", masked)
    return read.select(
        conv,
        F.size("parsed").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("__loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("__loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def planted(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts hold the template's own control strings."""
    text = F.lit(r"\### Assistant: </turn> ok")
    roles = F.posexplode(F.array(F.lit("user"), F.lit("assistant"))).alias("turn", "role")
    return spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), roles).select("conv_id", F.col("turn").cast("long").alias("turn"), "role", text.alias("text"))


def report(conversations: DataFrame) -> DataFrame:
    rows = conversations.select("conv_id", "turn", "role", "text")
    return digest(format_conversations(rows.unionByName(planted(rows.sparkSession))))


ORACLE_SQL = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
e AS (SELECT *, CASE WHEN contains(text, '###') OR contains(text, '</turn>') OR regexp_matches(text, '(?s)\\.')
  THEN replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '<\/turn>') ELSE text END AS safe FROM r)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(4 + length(role) + 2 + length(safe) + 8)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
