"""Deterministic evaluation data derived from the star-schema tables, for Spark and as SQL.

cards: one templated text a customer, with exact gold spans. records: cards x 5 models x 6 conditions, with
dropped, shifted, relabelled and spurious predictions that integer arithmetic decides; a third of the gold
has no offsets. Records are nested rows made in place: no shuffle but the broadcast of nation (25 rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.functions import labels

CONDITIONS = ["zero_shot", "with_docs", "with_tools", "with_skills", "few_shot", "cot"]
SOURCES = ["alpha", "beta", "gamma"]
TYPES = ["PERSON", "EMAIL_ADDRESS", "PHONE_NUMBER", "LOCATION"]
ALIASES = ["NAME", "email", "phone number", "CITY"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, source, text, gold0 (with offsets) and gold (a third without)."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    both = customer.join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("c_custkey").cast("string")
    email, phone = F.concat(F.lit("user"), key, F.lit("@mail.example")), F.concat(F.lit("555-"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"))
    parts = [("Contact ", F.col("c_name")), (" at ", email), (" or call ", phone), (" in ", F.col("n_name"))]
    at, text, gold = F.lit(0), [], []
    for (gap, value), kind in zip(parts, TYPES, strict=True):
        start = at + len(gap)
        at = start + F.length(value)
        text += [F.lit(gap), value]
        gold.append(F.struct(F.lit(kind).alias("type"), value.alias("text"), start.alias("start"), at.alias("stop")))
    gold0 = F.array(*gold)
    bare = F.transform(gold0, lambda g: F.struct(g["type"].alias("type"), g["text"].alias("text"), F.lit(0).alias("start"), F.lit(0).alias("stop")))
    return both.select(
        F.col("c_custkey").cast("long").alias("key"),
        F.element_at(F.array(*map(F.lit, SOURCES)), (F.col("c_custkey") % 3 + 1).cast("int")).alias("source"),
        F.concat(*text, F.lit(".")).alias("text"),
        gold0.alias("gold0"),
        F.when(F.col("c_custkey") % 3 == 0, bare).otherwise(gold0).alias("gold"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, sample_id, source, model, condition, preds, gold and the attributes of a run."""
    # one row becomes thirty costly ones, so the few narrow rows of a small file are dealt out first
    base = cards(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism).withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5))))
    h = lambda i: ((F.col("key") * 31 + i * 17 + F.col("m") * 7 + F.col("k") * 13) % 100).cast("int")
    base = base.withColumn("hs", F.array(*[h(i) for i in range(4)]))
    exact = F.col("k").isin(2, 3)

    def kept(i: Column) -> Column:
        x, g = F.get("hs", i), F.get("gold0", i)
        label = F.when(x % 4 == 0, F.get(F.array(*map(F.lit, ALIASES)), i)).when((x % 7 == 3) & (i == 3), "ADDRESS").when((x % 7 == 3) & (i == 1), "email id").otherwise(g["type"])
        shift = F.when(exact, 0).otherwise(x % 5 - 2)
        return F.struct(label.alias("type"), g["text"].alias("text"), F.greatest(F.lit(0), g["start"] + shift).alias("start"), (g["stop"] + shift).alias("stop"))

    def extra(i: Column) -> Column:
        return F.struct(F.when(i == 1, "DATE").when(i == 2, "DATE_TIME").otherwise("URL").alias("type"), F.lit("Contact").alias("text"), F.lit(0).alias("start"), F.lit(7).alias("stop"))

    places = F.sequence(F.lit(0), F.lit(3))
    mine = F.transform(F.filter(places, lambda i: F.get("hs", i) < 90 - 8 * F.col("k")), kept)
    more = F.transform(F.filter(places, lambda i: F.get("hs", i) % 11 == 0), extra)
    x = F.get("hs", 0)
    return base.select(
        "key",
        F.concat(F.lit("s"), F.col("key")).alias("sample_id"),
        "source",
        F.concat(F.lit("m"), F.col("m")).alias("model"),
        F.get(F.array(*map(F.lit, CONDITIONS)), F.col("k")).alias("condition"),
        F.concat(mine, more).alias("preds"),
        "gold",
        ((x % 50) / 10.0 + 1).alias("elapsed"),
        (1 + F.when(exact, x % 4).otherwise(0)).cast("long").alias("turns"),
        (exact & (x < 80)).alias("tool"),
        ((F.col("k") == 3) & (x % 3 != 0)).alias("skill"),
        F.when(x % 29 == 0, "timeout").otherwise("").alias("error"),
    )


# ---- the same in DuckDB's SQL ----

CARDS_SQL = """
parts AS (SELECT c_custkey::BIGINT AS key, ['alpha', 'beta', 'gamma'][c_custkey % 3 + 1] AS source, c_name AS a, 'user' || c_custkey || '@mail.example' AS b,
  '555-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS c, n_name AS d FROM customer JOIN nation ON c_nationkey = n_nationkey),
cuts AS (SELECT *, 8 AS s0, 8 + length(a) AS e0, 12 + length(a) AS s1, 12 + length(a) + length(b) AS e1, 21 + length(a) + length(b) AS s2, 29 + length(a) + length(b) AS e2,
  33 + length(a) + length(b) AS s3, 33 + length(a) + length(b) + length(d) AS e3 FROM parts),
cards AS (SELECT key, source, 'Contact ' || a || ' at ' || b || ' or call ' || c || ' in ' || d || '.' AS text,
  [{'type': 'PERSON', 'text': a, 'start': s0, 'stop': e0}, {'type': 'EMAIL_ADDRESS', 'text': b, 'start': s1, 'stop': e1},
   {'type': 'PHONE_NUMBER', 'text': c, 'start': s2, 'stop': e2}, {'type': 'LOCATION', 'text': d, 'start': s3, 'stop': e3}] AS gold0,
  CASE WHEN key % 3 = 0 THEN list_transform(gold0, lambda g: {'type': g.type, 'text': g.text, 'start': 0::BIGINT, 'stop': 0::BIGINT}) ELSE gold0 END AS gold FROM cuts)
"""

RECORDS_SQL = (
    CARDS_SQL
    + """,
grid AS (SELECT cards.*, m.m, k.k, list_transform(range(0, 4), lambda i: (key * 31 + i * 17 + m.m * 7 + k.k * 13) % 100) AS hs FROM cards, range(5) m(m), range(6) k(k)),
records AS (SELECT key, 's' || key AS sample_id, source, 'm' || m AS model,
  ['zero_shot', 'with_docs', 'with_tools', 'with_skills', 'few_shot', 'cot'][k + 1] AS condition,
  list_concat(list_transform(list_filter(range(0, 4), lambda i: hs[i + 1] < 90 - 8 * k), lambda i: {
    'type': CASE WHEN hs[i + 1] % 4 = 0 THEN ['NAME', 'email', 'phone number', 'CITY'][i + 1] WHEN hs[i + 1] % 7 = 3 AND i = 3 THEN 'ADDRESS'
      WHEN hs[i + 1] % 7 = 3 AND i = 1 THEN 'email id' ELSE gold0[i + 1].type END,
    'text': gold0[i + 1].text,
    'start': greatest(0, gold0[i + 1].start + CASE WHEN k IN (2, 3) THEN 0 ELSE hs[i + 1] % 5 - 2 END)::BIGINT,
    'stop': (gold0[i + 1].stop + CASE WHEN k IN (2, 3) THEN 0 ELSE hs[i + 1] % 5 - 2 END)::BIGINT}),
   list_transform(list_filter(range(0, 4), lambda i: hs[i + 1] % 11 = 0), lambda i: {'type': CASE i WHEN 1 THEN 'DATE' WHEN 2 THEN 'DATE_TIME' ELSE 'URL' END,
    'text': 'Contact', 'start': 0::BIGINT, 'stop': 7::BIGINT})) AS preds,
  gold, (hs[1] % 50) / 10.0 + 1 AS elapsed, 1 + CASE WHEN k IN (2, 3) THEN hs[1] % 4 ELSE 0 END AS turns, k IN (2, 3) AND hs[1] < 80 AS tool,
  k = 3 AND hs[1] % 3 <> 0 AS skill, CASE WHEN hs[1] % 29 = 0 THEN 'timeout' ELSE '' END AS error FROM grid)
"""
)


def _list(names) -> str:
    return ", ".join("'" + n.replace("'", "''") + "'" for n in names)


def sql_key(label: str) -> str:
    return f"upper(replace(replace({label}, '-', '_'), ' ', '_'))"


def sql_map(k: str, how: str) -> str:
    """SQL for the canonical label of a key, under a map of labels.mapped()."""
    if how == "raw":
        return k
    tables = {"before": labels.BEFORE, "strict": labels.BASE}
    held = tables[how] if how in tables else labels.aligned(how)
    by: dict = {}
    for name, target in held.items():
        by.setdefault(target, []).append(name)
    own = f"CASE WHEN {k} IN ({_list(labels.CANON)}) THEN {k} END"
    none = {"strict": own}.get(how, "'UNKNOWN'")
    whens = " ".join(f"WHEN {k} IN ({_list(names)}) THEN " + (none if t is None else f"'{t}'") for t, names in by.items())
    rest = own if how == "strict" else k
    if how in labels.VARIANTS:
        rest = "CASE " + " ".join(f"WHEN regexp_matches({k}, '{p}') THEN '{t}'" for p, t in labels.rules(how)) + f" ELSE {k} END"
    empty = "NULL" if how == "strict" else "'UNKNOWN'"
    return f"CASE WHEN coalesce({k}, '') = '' THEN {empty} {whens} ELSE {rest} END"


def sql_norm(items: str, how: str) -> str:
    keyed = f"list_transform({items}, lambda s: {{'k': {sql_key('s.type')}, 'start': s.start, 'stop': s.stop}})"
    return f"list_transform({keyed}, lambda s: {{'type': {sql_map('s.k', how)}, 'start': s.start, 'stop': s.stop}})"


IOU_SQL = "(CASE WHEN ({p}.stop - {p}.start) + ({g}.stop - {g}.start) - greatest(0, least({p}.stop, {g}.stop) - greatest({p}.start, {g}.start)) > 0 THEN greatest(0, least({p}.stop, {g}.stop) - greatest({p}.start, {g}.start))::DOUBLE / (({p}.stop - {p}.start) + ({g}.stop - {g}.start) - greatest(0, least({p}.stop, {g}.stop) - greatest({p}.start, {g}.start))) ELSE 0 END)"


def sql_taken(pn: str, gn: str, mode: str) -> str:
    """SQL for the places (from 1) of gold taken by greedy matching."""
    g = f"{gn}[i]"
    bare = f"({g}.start = 0 AND {g}.stop = 0)"
    test = {"type": "true", "strict": f"({bare} OR p.start = {g}.start AND p.stop = {g}.stop)", "span": f"({bare} OR {IOU_SQL.format(p='p', g=g)} >= 0.5)"}[mode]
    options = f"list_transform({pn}, lambda p: list_filter(range(1, len({gn}) + 1), lambda i: {g}.type = p.type AND {test}))"
    return f"list_reduce({options}, lambda u, x: list_concat(u, list_filter(x, lambda i: NOT list_contains(u, i))[1:1]), []::BIGINT[])"


def scored_sql(modes) -> str:
    """CTEs up to `scored`: records with n_pred, n_gold and, for each (mode, map, name), tp_, f1, p_ and r_."""
    hows = list(dict.fromkeys(how for _, how, _ in modes))
    normed = ", ".join(f"{sql_norm('preds', h)} AS p_{h}, {sql_norm('gold', h)} AS g_{h}" for h in hows)
    tps = ", ".join(f"len({sql_taken(f'p_{h}', f'g_{h}', mode)}) AS tp_{name}" for mode, h, name in modes)
    scores = ", ".join(
        f"CASE WHEN n_gold = 0 THEN CASE WHEN n_pred = 0 THEN 1.0 ELSE 0.0 END ELSE 2.0::DOUBLE * tp_{n} / (n_pred + n_gold) END AS {n}, "
        f"CASE WHEN n_gold = 0 THEN CASE WHEN n_pred = 0 THEN 1.0 ELSE 0.0 END WHEN n_pred = 0 THEN 0.0 ELSE tp_{n}::DOUBLE / n_pred END AS p_{n}, "
        f"CASE WHEN n_gold = 0 THEN 1.0 WHEN n_pred = 0 THEN 0.0 ELSE tp_{n}::DOUBLE / n_gold END AS r_{n}"
        for _, _, n in modes
    )
    return f"{RECORDS_SQL}, normed AS (SELECT *, len(preds) AS n_pred, len(gold) AS n_gold, {normed} FROM records), tps AS (SELECT *, {tps} FROM normed), scored AS (SELECT *, {scores} FROM tps)"
