"""Queries of matching, analytics and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanmill.functions import labels, spans, stats
from spanmill.operators import analytics as A
from spanmill.operators import match, runner
from spanmill.plans.fixtures import CONDITIONS, IOU_SQL, RECORDS_SQL, records, scored_sql, sql_key, sql_map, sql_norm, table
from spanmill.plans.registry import query, r6

ALL = {"ft": ("type", "full"), "fs": ("span", "full"), "fx": ("strict", "full"), "bt": ("type", "before"), "bs": ("span", "before")}


def sc(spark, d, *names):
    """Scored records with the named scores, P and R among them."""
    return match.scored(records(spark, d), tuple((*ALL[n], n + "+") for n in names))


def sql(body: str, *names: str) -> str:
    return f"WITH {scored_sql([(*ALL[n], n) for n in names])} {body}" if names else f"WITH {RECORDS_SQL} {body}"


def rounded(df, *keep):
    return df.select(*[F.col(c) if c in keep or not t.startswith("double") else r6(c).alias(c) for c, t in df.dtypes])


# ---- matching ----


@query("c2_results_with_gold", sql("SELECT model, condition, count(*) AS n, count(b.key) AS with_gold, sum(CASE WHEN b.key IS NULL THEN 0 ELSE len(b.g) END)::BIGINT AS gold FROM records r LEFT JOIN (SELECT DISTINCT key, gold AS g FROM records WHERE key % 13 <> 0) b USING (key) GROUP BY ALL"))
def _(spark, d):
    base = records(spark, d)
    bench = base.filter("key % 13 <> 0 and model = 'm0' and condition = 'cot'").select("key", F.col("gold").alias("g"))
    both = base.select("model", "condition", "key").join(bench, "key", "left")
    return both.groupBy("model", "condition").agg(F.count("*").alias("n"), F.count("g").alias("with_gold"), F.sum(F.when(F.col("g").isNotNull(), F.size("g")).otherwise(0)).alias("gold"))


@query("c5_paired_runs", sql("SELECT a.model, a.condition, count(*) AS n, round(avg(b.fs - a.fs), 6) + 0.0::DOUBLE AS mean_delta FROM scored a JOIN scored b ON a.key = b.key AND a.condition = b.condition AND b.model = 'm4' WHERE a.model <> 'm4' GROUP BY ALL", "fs"))
def _(spark, d):
    s = sc(spark, d, "fs").select("model", "condition", "key", "fs")
    two = s.filter("model = 'm4'").select("condition", "key", F.col("fs").alias("other"))
    return s.filter("model <> 'm4'").join(two, ["condition", "key"]).groupBy("model", "condition").agg(F.count("*").alias("n"), r6(F.avg(F.col("other") - F.col("fs"))).alias("mean_delta"))


PAIRS = [("zero_shot", "with_tools"), ("zero_shot", "with_docs"), ("zero_shot", "with_skills"), ("with_docs", "with_tools"), ("with_docs", "with_skills"), ("with_tools", "with_skills")]


def deltas_sql(body: str, score: str = "fs") -> str:
    parts = " UNION ALL ".join(f"SELECT a.model, a.key, '{b} - {a}' AS comparison, b.{score} - a.{score} AS delta FROM scored a JOIN scored b ON a.model = b.model AND a.key = b.key AND a.condition = '{a}' AND b.condition = '{b}'" for a, b in PAIRS)
    return f"WITH {scored_sql([(*ALL[score], score)])}, deltas AS ({parts}) {body}"


def deltas(spark, d, score="fs"):
    return A.paired(sc(spark, d, score), score, PAIRS).groupBy("model", "comparison")


@query("c6_paired_by_sample", deltas_sql("SELECT model, comparison, count(*) AS n, round(sum(delta), 6) AS total FROM deltas GROUP BY ALL"))
def _(spark, d):
    return deltas(spark, d).agg(F.count("*").alias("n"), r6(F.sum("delta")).alias("total"))


@query("c7_label_lookup", sql(f"SELECT k AS label, {sql_map('k', 'before')} AS mapped, count(*) AS n FROM (SELECT {sql_key('p.type')} AS k FROM (SELECT unnest(preds) AS p FROM records)) GROUP BY ALL"))
def _(spark, d):
    flat = records(spark, d).select(F.explode("preds").alias("p"))
    return flat.groupBy(labels.key(F.col("p.type")).alias("label"), labels.lenient(F.col("p.type")).alias("mapped")).agg(F.count("*").alias("n"))


for _name, _score in (("c8_span_match", "fs"), ("c9_type_match", "ft"), ("c10_strict_match", "fx")):

    @query(_name, sql(f"SELECT key, model, condition, tp_{_score} AS tp FROM scored", _score))
    def _(spark, d, score=_score):
        return sc(spark, d, score).select("key", "model", "condition", F.col(f"tp_{score}").alias("tp"))


_KNOWN = ", ".join("'" + k.replace("'", "''") + "'" for k in labels.BEFORE)


@query("c11_label_cooccurrence", sql(f"""SELECT label, gold_type, count(*) AS n FROM (SELECT label, unnest(g) AS gold_type FROM (SELECT unnest(list_filter(list_transform(preds, lambda p: {sql_key('p.type')}), lambda k: k NOT IN ({_KNOWN}))) AS label,
  list_distinct(list_filter(list_transform(gold, lambda s: s.type), lambda t: t IS NOT NULL)) AS g FROM records)) GROUP BY ALL"""))
def _(spark, d):
    return match.label_pairs(records(spark, d), list(labels.BEFORE))


FUNNEL_SQL = f"""n AS (SELECT condition, {sql_norm('preds', 'full')} AS p, list_filter({sql_norm('gold', 'full')}, lambda g: g.start <> 0 OR g.stop <> 0) AS g FROM records),
h AS (SELECT condition, g, list_filter(list_transform(p, lambda x: {{'s': x, 'at': list_position(list_transform(g, lambda y: y.type), x.type)}}), lambda o: o.at > 0) AS o FROM n),
v AS (SELECT condition, len(g) AS gold, list_transform(o, lambda q: {{'at': q.at, 'v': {IOU_SQL.format(p='q.s', g='g[q.at]')}, 'e': q.s.start = g[q.at].start AND q.s.stop = g[q.at].stop}}) AS o FROM h),
u AS (SELECT condition, gold, len(list_distinct(list_transform(o, lambda q: q.at))) AS named, len(list_distinct(list_transform(list_filter(o, lambda q: q.v > 0), lambda q: q.at))) AS overlapped,
 len(list_distinct(list_transform(list_filter(o, lambda q: q.v >= 0.5), lambda q: q.at))) AS located, len(list_distinct(list_transform(list_filter(o, lambda q: q.e), lambda q: q.at))) AS exact FROM v)"""
STAGES = ("named", "overlapped", "located", "exact")


@query("c12_detection_funnel", f"WITH {RECORDS_SQL}, {FUNNEL_SQL} SELECT condition, sum(gold)::BIGINT AS gold_spans, {', '.join(f'sum({s})::BIGINT AS {s}' for s in STAGES)} FROM u GROUP BY condition")
def _(spark, d):
    return match.funnel(records(spark, d)).groupBy("condition").agg(F.sum("gold_spans").alias("gold_spans"), *[F.sum(s).alias(s) for s in STAGES])


@query("d30_funnel_table", f"WITH {RECORDS_SQL}, {FUNNEL_SQL}, t AS (SELECT condition, sum(gold) AS gold, {', '.join(f'sum({s}) AS {s}' for s in STAGES)} FROM u GROUP BY condition) SELECT condition, gold::BIGINT AS gold, {', '.join(f'round(100.0 * {s} / gold, 6) AS {s}_pct' for s in STAGES)}, round(100.0 * overlapped / named, 6) AS overlap_given_named, round(100.0 * exact / overlapped, 6) AS exact_given_overlap FROM t")
def _(spark, d):
    return rounded(A.funnel_table(records(spark, d)))


_TRUE = {"named": "true", "overlapped": f"{IOU_SQL.format(p='x', g='s')} > 0", "located": f"{IOU_SQL.format(p='x', g='s')} >= 0.5", "exact": "x.start = s.start AND x.stop = s.stop"}


@query("z9_true_funnel", f"WITH {RECORDS_SQL}, n AS (SELECT condition, {sql_norm('preds', 'full')} AS p, list_filter({sql_norm('gold', 'full')}, lambda g: g.start <> 0 OR g.stop <> 0) AS g FROM records) SELECT condition, sum(len(g))::BIGINT AS gold_spans, {', '.join(f'sum(len(list_filter(g, lambda s: len(list_filter(p, lambda x: x.type = s.type AND {t})) > 0)))::BIGINT AS {n}' for n, t in _TRUE.items())} FROM n GROUP BY condition")
def _(spark, d):
    return match.true_funnel(records(spark, d)).groupBy("condition").agg(F.sum("gold_spans").alias("gold_spans"), *[F.sum(s).alias(s) for s in STAGES])


OFFSETS = """raw_in AS (SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN n_chars::VARCHAR WHEN 1 THEN ' ' || n_chars || ' ' WHEN 2 THEN '-' || n_chars WHEN 3 THEN '+' || n_chars WHEN 4 THEN '<REDACTED>'
  WHEN 5 THEN NULL WHEN 6 THEN '' WHEN 7 THEN n_chars || '.5' WHEN 8 THEN '--' || n_chars ELSE '0' END AS raw FROM documents)"""


def offset_rows(spark, d):
    """An offset in one of ten spellings for each document."""
    k, n = F.col("doc_id") % 10, F.col("n_chars").cast("string")
    kinds = [n, F.concat(F.lit(" "), n, F.lit(" ")), F.concat(F.lit("-"), n), F.concat(F.lit("+"), n), F.lit("<REDACTED>"), F.lit(None).cast("string"), F.lit(""), F.concat(n, F.lit(".5")), F.concat(F.lit("--"), n), F.lit("0")]
    return table(spark, d, "documents").select("doc_id", F.get(F.array(*kinds), k.cast("int")).alias("raw"))


@query("h1_offset", f"WITH {OFFSETS} SELECT doc_id, raw, CASE WHEN regexp_full_match(trim(raw), '[+-]?[0-9]+') THEN trim(raw)::INT ELSE 0 END AS value FROM raw_in")
def _(spark, d):
    return offset_rows(spark, d).select("doc_id", "raw", spans.offset(F.col("raw")).alias("value"))


@query("h1b_offset_digits", f"WITH {OFFSETS} SELECT doc_id, raw, CASE WHEN regexp_full_match(raw, '-*[0-9]+') THEN coalesce(try_cast(raw AS INT), 0) ELSE 0 END AS value FROM raw_in")
def _(spark, d):
    return offset_rows(spark, d).select("doc_id", "raw", spans.offset_digits(F.col("raw")).alias("value"))


@query("h2_span_iou", sql(f"SELECT key, model, condition, round({IOU_SQL.format(p='preds[1]', g='gold[1]')}, 6) AS iou FROM records WHERE len(preds) > 0"))
def _(spark, d):
    p, g = F.get("preds", F.lit(0)), F.get("gold", F.lit(0))
    return records(spark, d).filter(F.size("preds") > 0).select("key", "model", "condition", r6(spans.iou(p["start"], p["stop"], g["start"], g["stop"])).alias("iou"))


@query("h3_precision_recall_f1", sql("SELECT key, model, condition, round(p_fs, 6) AS p, round(r_fs, 6) AS r, round(fs, 6) AS f1 FROM scored", "fs"))
def _(spark, d):
    return sc(spark, d, "fs").select("key", "model", "condition", r6("p_fs").alias("p"), r6("r_fs").alias("r"), r6("fs").alias("f1"))


@query("h3b_f1_only", sql("SELECT key, model, condition, round(bt, 6) AS f1 FROM scored", "bt"))
def _(spark, d):
    return match.scored(records(spark, d), (("type", "before", "bt"),)).select("key", "model", "condition", r6("bt").alias("f1"))


@query("b18_span_bearing", sql("SELECT source, count(*) FILTER (len(list_filter(gold, lambda g: g.start <> 0 OR g.stop <> 0)) > 0) AS bearing, count(*) AS n FROM records GROUP BY source"))
def _(spark, d):
    return records(spark, d).groupBy("source").agg(F.count_if(spans.any_span(F.col("gold"))).alias("bearing"), F.count("*").alias("n"))


@query("b19_gold_selection", sql("SELECT DISTINCT key, CASE WHEN len(list_filter(gold, lambda g: g.start <> 0 OR g.stop <> 0)) > 0 THEN 'spans' WHEN key % 2 = 0 THEN 'canonical' ELSE 'raw' END AS chosen FROM records"))
def _(spark, d):
    canonical = F.when(F.col("key") % 2 == 0, F.transform("gold", lambda g: g["type"]))
    chosen = F.when(spans.any_span(F.col("gold")), "spans").when(canonical.isNotNull(), "canonical").otherwise("raw")
    return records(spark, d).select("key", chosen.alias("chosen")).distinct()


@query("b12_model_condition_filter", sql("SELECT key, model FROM records WHERE condition = 'with_tools' AND model IN ('m1', 'm3')"))
def _(spark, d):
    return records(spark, d).filter((F.col("condition") == "with_tools") & F.col("model").isin("m1", "m3")).select("key", "model")


@query("b15_flat_results", sql("SELECT key, model, condition, len(preds) AS n_predictions, len(gold) AS n_gold, error <> '' AS has_error, tool, skill FROM records"))
def _(spark, d):
    return records(spark, d).select("key", "model", "condition", F.size("preds").cast("long").alias("n_predictions"), F.size("gold").cast("long").alias("n_gold"), (F.col("error") != "").alias("has_error"), "tool", "skill")


@query("b16_score_frame", f"WITH {scored_sql([('span', 'full', 'fs')])}, k AS (SELECT *, list_transform(g_full, lambda s: s.type) AS ts FROM scored) SELECT key, model, condition, round(fs, 6) AS f1, elapsed::DOUBLE AS elapsed, turns::BIGINT AS turns, tool::INT AS tool, skill::INT AS skill, array_to_string(list_sort(list_distinct(ts)), ', ') AS pii_types FROM k")
def _(spark, d):
    s = match.scored(records(spark, d), (("span", "full", "fs"),)).withColumn("ts", F.transform(match.normalised(F.col("gold"), "full"), lambda g: g["type"]))
    return s.select("key", "model", "condition", r6("fs").alias("f1"), F.coalesce("elapsed", F.lit(0.0)).alias("elapsed"), F.coalesce("turns", F.lit(1).cast("long")).alias("turns"), F.col("tool").cast("int").alias("tool"), F.col("skill").cast("int").alias("skill"), F.array_join(F.array_sort(F.array_distinct("ts")), ", ").alias("pii_types"))


@query("b20_condition_flags", sql("SELECT condition, condition = 'with_skills' AS skills, condition IN ('with_docs', 'with_skills') AS docs, condition IN ('with_tools', 'with_skills') AS tools, count(*) AS n FROM records GROUP BY condition"))
def _(spark, d):
    flags = {c: runner.condition_flags(c) for c in CONDITIONS}
    seen = records(spark, d).groupBy("condition").agg(F.count("*").alias("n"))
    own = lambda name: F.create_map(*[F.lit(x) for c, f in flags.items() for x in (c, f[name])])[F.col("condition")]
    return seen.select("condition", own("with_skills").alias("skills"), own("with_docs").alias("docs"), own("with_tools").alias("tools"), "n")


# ---- analytics ----


@query("d1_run_summary", sql("SELECT model, condition, count(*) AS n, count(*) FILTER (error <> '') AS errors, count(*) FILTER (tool) AS tool_calls, round(sum(elapsed)::DOUBLE, 6) AS total_seconds, round(avg(elapsed)::DOUBLE, 6) AS mean_seconds FROM records GROUP BY ALL"))
def _(spark, d):
    return rounded(A.run_summary(records(spark, d)))


@query("d2_answer_summary", sql("SELECT model, condition, count(*) AS n, count(*) FILTER (error <> '') AS errors, round(avg(len(preds)), 6) AS mean_preds, round(avg(len(gold)), 6) AS mean_gold, count(*) FILTER (tool) AS tool_calls, count(*) FILTER (skill) AS skills_viewed FROM records GROUP BY ALL"))
def _(spark, d):
    return rounded(A.answer_summary(records(spark, d)))


@query("d3_score_summary", sql("SELECT model, condition, count(*) AS n, round(avg(fs), 6) AS mean_f1, round(avg(p_fs), 6) AS mean_p, round(avg(r_fs), 6) AS mean_r, round(quantile_cont(fs, 0.5), 6) AS median_f1, count(*) FILTER (tool) AS tool_calls, round(avg(elapsed)::DOUBLE, 6) AS mean_seconds, round(avg(turns), 6) AS mean_turns FROM scored GROUP BY ALL", "fs"))
def _(spark, d):
    return rounded(A.score_summary(sc(spark, d, "fs"), "fs", "p_fs", "r_fs"))


@query("d11_tool_totals", sql("SELECT model, count(*) FILTER (tool) AS tool_calls FROM records WHERE condition IN ('with_tools', 'with_skills') GROUP BY model"))
def _(spark, d):
    return records(spark, d).filter(F.col("condition").isin("with_tools", "with_skills")).groupBy("model").agg(F.count_if("tool").alias("tool_calls"))


@query("d12_date_labels", sql("SELECT model, sum(len(list_filter(preds, lambda p: p.type = 'DATE')))::BIGINT AS dates, sum(len(list_filter(preds, lambda p: p.type = 'DATE_TIME')))::BIGINT AS date_times FROM records GROUP BY model"))
def _(spark, d):
    flat = records(spark, d).select("model", F.explode("preds").alias("p"))
    return flat.groupBy("model").agg(F.count_if(F.col("p.type") == "DATE").alias("dates"), F.count_if(F.col("p.type") == "DATE_TIME").alias("date_times"))


@query("d15_macro_f1", sql("SELECT model, condition, round(avg(ft), 6) AS f1_type, round(avg(fs), 6) AS f1_span, round(avg(bt), 6) AS f1_type_before, round(avg(bs), 6) AS f1_span_before FROM scored GROUP BY ALL", "ft", "fs", "bt", "bs"))
def _(spark, d):
    names = {"f1_type": "ft", "f1_span": "fs", "f1_type_before": "bt", "f1_span_before": "bs"}
    s = match.scored(records(spark, d), tuple((*ALL[n], n) for n in names.values()))
    return s.groupBy("model", "condition").agg(*[r6(F.avg(n)).alias(o) for o, n in names.items()])


def counts_sql(body: str) -> str:
    flat = f"SELECT model, condition, key, unnest(list_concat(list_transform({sql_norm('gold', 'full')}, lambda s: {{'t': s.type, 'g': 1, 'p': 0}}), list_transform({sql_norm('preds', 'full')}, lambda s: {{'t': s.type, 'g': 0, 'p': 1}}))) AS s FROM records"
    return f"WITH {RECORDS_SQL}, f AS ({flat}), counts AS (SELECT model, condition, key, s.t AS type, sum(s.g) AS n_gold, sum(s.p) AS n_pred FROM f GROUP BY ALL) {body}"


MACRO = "SELECT model, condition, type, avg(least(n_pred / n_gold, 1.0)) AS recall, sum(n_gold) AS support FROM counts WHERE n_gold > 0 GROUP BY ALL"
MICRO = "SELECT model, condition, type, sum(least(n_gold, n_pred)) / sum(n_gold) AS recall FROM counts WHERE n_gold > 0 GROUP BY ALL"


@query("d16_recall_macro", counts_sql(f"SELECT model, condition, type, round(recall, 6) AS recall, support::BIGINT AS support FROM ({MACRO})"))
def _(spark, d):
    return rounded(A.recall_macro(A.type_counts(records(spark, d))))


@query("d17_recall_micro", counts_sql(f"SELECT model, condition, type, round(recall, 6) AS recall FROM ({MICRO})"))
def _(spark, d):
    return rounded(A.recall_micro(A.type_counts(records(spark, d))))


def hits_sql() -> str:
    from spanmill.plans.fixtures import sql_taken

    one = lambda how, name: f"SELECT '{name}' AS map, unnest(list_transform(range(1, len(g) + 1), lambda i: {{'t': f[i].type, 'h': list_contains(taken, i)}})) AS x FROM (SELECT gn AS g, f, {sql_taken('pn', 'gn', 'type')} AS taken FROM (SELECT {sql_norm('preds', how)} AS pn, {sql_norm('gold', how)} AS gn, {sql_norm('gold', 'full')} AS f FROM records))"
    return f"hits AS ({one('before', 'before')} UNION ALL {one('full', 'after')})"


@query("d18_recall_by_maps", f"WITH {RECORDS_SQL}, {hits_sql()} SELECT x.t AS type, round(count(*) FILTER (map = 'before' AND x.h) / count(*) FILTER (map = 'before'), 6) AS before, round(count(*) FILTER (map = 'after' AND x.h) / count(*) FILTER (map = 'after'), 6) AS after, count(*) // 2 AS support FROM hits GROUP BY x.t HAVING count(*) // 2 >= 50")
def _(spark, d):
    return rounded(A.recall_by_maps(records(spark, d)))


@query("d19_over_prediction", f"WITH {RECORDS_SQL}, p AS (SELECT unnest({sql_norm('preds', 'full')}).type AS type FROM records), g AS (SELECT unnest({sql_norm('gold', 'full')}).type AS type FROM (SELECT DISTINCT key, gold FROM records)), pc AS (SELECT type, count(*) AS predicted FROM p GROUP BY type), gc AS (SELECT type, count(*) AS support FROM g GROUP BY type) SELECT type, predicted, coalesce(support, 0) AS support, CASE WHEN support > 0 THEN round(predicted / support, 1) ELSE 'inf'::DOUBLE END AS ratio FROM pc LEFT JOIN gc USING (type) ORDER BY predicted DESC, type LIMIT 12")
def _(spark, d):
    return A.over_prediction(records(spark, d))


_PIVOT = ", ".join(f"round(max(fs) FILTER (condition = '{c}'), 6) AS {c}" for c in CONDITIONS)


@query("d20_condition_pivot", sql(f"SELECT model, key, {_PIVOT} FROM scored GROUP BY ALL", "fs"))
def _(spark, d):
    return rounded(A.pivoted(match.scored(records(spark, d), (("span", "full", "fs"),)), ["model", "key"], "fs", CONDITIONS, F.max))


@query("d21_pairwise_deltas", deltas_sql("SELECT model, comparison, round(avg(delta), 6) AS mean_delta, round(100.0 * count(*) FILTER (delta > 0) / count(*), 6) AS pct_improved FROM deltas GROUP BY ALL"))
def _(spark, d):
    return deltas(spark, d).agg(r6(F.avg("delta")).alias("mean_delta"), r6(stats.share_positive(F.col("delta"))).alias("pct_improved"))


_MEANS = ", ".join(f"coalesce(avg(fs) FILTER (condition = '{c}'), 0) AS {c}" for c in CONDITIONS)
_OTHER = [c for c in CONDITIONS if c != "zero_shot"]


def mean_wide(spark, d):
    return A.pivoted(match.scored(records(spark, d), (("span", "full", "fs"),)), ["model"], "fs", CONDITIONS).na.fill(0.0)


@query("d22_degradation", sql(f"SELECT model, {', '.join(f'round({c} - zero_shot, 6) AS {c}' for c in _OTHER)} FROM (SELECT model, {_MEANS} FROM scored GROUP BY model)", "fs"))
def _(spark, d):
    return mean_wide(spark, d).select("model", *[r6(F.col(c) - F.col("zero_shot")).alias(c) for c in _OTHER])


@query("d23_improvement", sql(f"SELECT model, round(zero_shot, 6) AS zero_shot, {', '.join(f'CASE WHEN zero_shot > 0 THEN round(100 * ({c} - zero_shot) / zero_shot, 6) ELSE 0 END AS {c}' for c in _OTHER)} FROM (SELECT model, {_MEANS} FROM scored GROUP BY model)", "fs"))
def _(spark, d):
    w = mean_wide(spark, d)
    return w.select("model", r6("zero_shot").alias("zero_shot"), *[r6(A.relative(w, F.col(c), F.col("zero_shot"))).alias(c) for c in _OTHER])


@query("d24_reliability", sql(f"SELECT model, {', '.join(f'''round(100.0 * count(*) FILTER (condition = '{c}' AND error <> '') / count(*) FILTER (condition = '{c}'), 6) AS err_{c}, round(avg(len(preds)) FILTER (condition = '{c}'), 6) AS preds_{c}''' for c in CONDITIONS)}, round(avg(len(gold)), 6) AS mean_gold FROM records GROUP BY model"))
def _(spark, d):
    cols = []
    for c in CONDITIONS:
        own = F.col("condition") == c
        cols += [r6(100 * F.count_if(own & (F.col("error") != "")) / F.count_if(own)).alias(f"err_{c}"), r6(F.avg(F.when(own, F.size("preds")))).alias(f"preds_{c}")]
    return records(spark, d).groupBy("model").agg(*cols, r6(F.avg(F.size("gold"))).alias("mean_gold"))


@query("d25_skill_split", sql("SELECT model, n, round(rate, 6) AS rate, round(coalesce(v, 0), 6) AS f1_viewed, round(coalesce(o, 0), 6) AS f1_other, round(coalesce(v, 0) - coalesce(o, 0), 6) AS difference, round(v - o, 6) AS difference_or_null FROM (SELECT model, count(*) AS n, count(*) FILTER (skill) / count(*) AS rate, avg(fs) FILTER (skill) AS v, avg(fs) FILTER (NOT skill) AS o FROM scored WHERE condition = 'with_skills' GROUP BY model)", "fs"))
def _(spark, d):
    return rounded(A.skill_split(match.scored(records(spark, d), (("span", "full", "fs"),)), "fs"))


@query("d27_efficiency", sql("SELECT model, condition, round(avg(fs), 6) AS mean_f1, count(*) FILTER (tool) AS tools, CASE WHEN count(*) FILTER (tool) > 0 THEN round(avg(fs) / count(*) FILTER (tool), 6) ELSE 0 END AS f1_per_tool FROM scored GROUP BY ALL", "fs"))
def _(spark, d):
    s = match.scored(records(spark, d), (("span", "full", "fs"),)).groupBy("model", "condition").agg(F.avg("fs").alias("f"), F.count_if("tool").alias("tools"))
    return s.select("model", "condition", r6("f").alias("mean_f1"), "tools", r6(F.when(F.col("tools") > 0, F.col("f") / F.col("tools")).otherwise(0.0)).alias("f1_per_tool"))


_SCALED = ", ".join(
    f"round({'1 - ' if c == 'speed' else ''}(CASE WHEN max({c}) OVER w > min({c}) OVER w THEN ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) ELSE 0.5 END), 6) AS {c}"
    for c in ("f1", "precision", "recall", "speed", "tool_use")
)


@query("d28_condition_profile", sql(f"SELECT model, condition, {_SCALED} FROM (SELECT model, condition, round(avg(fs), 9) AS f1, round(avg(p_fs), 9) AS precision, round(avg(r_fs), 9) AS recall, round(avg(elapsed)::DOUBLE, 9) AS speed, round(avg(tool::INT), 9) AS tool_use FROM scored GROUP BY ALL) WINDOW w AS (PARTITION BY model)", "fs"))
def _(spark, d):
    return rounded(A.profile(sc(spark, d, "fs"), "fs", "p_fs", "r_fs"))


@query("d29_span_strata", sql("SELECT source, count(*) // count(DISTINCT model) AS samples, bool_or(b) AS span_bearing, round(100.0 * count(*) FILTER (b) / count(*), 6) AS span_pct FROM (SELECT source, model, len(list_filter(gold, lambda g: g.start <> 0 OR g.stop <> 0)) > 0 AS b FROM records WHERE condition = 'zero_shot') GROUP BY source"))
def _(spark, d):
    return rounded(A.strata(records(spark, d)))


@query("d31_strict_table", sql(f"SELECT condition, {', '.join(f'round(avg({s}), 6) AS {s}_all, round(avg({s}) FILTER (key % 3 <> 0), 6) AS {s}_spans' for s in ('ft', 'fs', 'fx'))} FROM scored GROUP BY condition", "ft", "fs", "fx"))
def _(spark, d):
    names = ("ft", "fs", "fx")
    s = match.scored(records(spark, d), tuple((*ALL[n], n) for n in names)).withColumn("bears", spans.any_span(F.col("gold")))
    return s.groupBy("condition").agg(*[x for n in names for x in (r6(F.avg(n)).alias(f"{n}_all"), r6(F.avg(F.when(F.col("bears"), F.col(n)))).alias(f"{n}_spans"))])


@query("d33_model_strict_table", sql("SELECT model, condition, round(avg(ft), 6) AS f1_type, round(avg(fs), 6) AS f1_span, round(avg(fx), 6) AS f1_strict, round(min(fx), 6) AS min_strict, round(max(fx), 6) AS max_strict FROM scored GROUP BY ALL", "ft", "fs", "fx"))
def _(spark, d):
    s = match.scored(records(spark, d), tuple((*ALL[n], n) for n in ("ft", "fs", "fx")))
    return s.groupBy("model", "condition").agg(r6(F.avg("ft")).alias("f1_type"), r6(F.avg("fs")).alias("f1_span"), r6(F.avg("fx")).alias("f1_strict"), r6(F.min("fx")).alias("min_strict"), r6(F.max("fx")).alias("max_strict"))


def _variants_sql() -> str:
    modes = [(m, v, f"{m[0]}_{v}") for v in labels.VARIANTS for m in ("type", "span")]
    cells = lambda v: ", ".join(f"avg({m}_{v}) FILTER (condition = '{c}') AS {m}_{n}" for m in ("t", "s") for c, n in (("zero_shot", "zs"), ("with_tools", "tool")))
    parts = " UNION ALL ".join(f"SELECT '{v}' AS variant, {cells(v)} FROM scored" for v in labels.VARIANTS)
    return f"WITH {scored_sql(modes)} SELECT variant, round(t_zs - t_tool, 6) AS type_gap, round(s_zs - s_tool, 6) AS span_gap, t_zs > t_tool AND s_zs < s_tool AS inverts FROM ({parts})"


@query("d32_map_sensitivity", _variants_sql())
def _(spark, d):
    base = records(spark, d).filter(F.col("condition").isin("zero_shot", "with_tools"))
    s = match.scored(base, tuple((m, v, f"{m[0]}_{v}") for v in labels.VARIANTS for m in ("type", "span")))
    gap = lambda c: F.avg(F.when(F.col("condition") == "zero_shot", F.col(c))) - F.avg(F.when(F.col("condition") == "with_tools", F.col(c)))
    one = s.agg(*[gap(f"{m}_{v}").alias(f"{m}_{v}") for v in labels.VARIANTS for m in ("t", "s")])
    rows = F.array(*[F.struct(F.lit(v).alias("variant"), F.col(f"t_{v}").alias("t"), F.col(f"s_{v}").alias("s")) for v in labels.VARIANTS])
    return one.select(F.explode(rows).alias("r")).select("r.variant", r6("r.t").alias("type_gap"), r6("r.s").alias("span_gap"), ((F.col("r.t") > 0) & (F.col("r.s") < 0)).alias("inverts"))


@query("d34_scale_comparison", sql("SELECT condition, round((avg(f) FILTER (model <> 'm4')), 6) AS mean_small, round(max(f) FILTER (model = 'm4'), 6) AS large FROM (SELECT model, condition, avg(fs) AS f FROM scored GROUP BY ALL) GROUP BY condition", "fs"))
def _(spark, d):
    m = match.scored(records(spark, d), (("span", "full", "fs"),)).groupBy("model", "condition").agg(F.avg("fs").alias("f"))
    big = F.col("model") == "m4"
    return m.groupBy("condition").agg(r6(F.avg(F.when(~big, F.col("f")))).alias("mean_small"), r6(F.max(F.when(big, F.col("f")))).alias("large"))


_BASE = [(s, c) for s in ("ft", "fs") for c in ("zero_shot", "few_shot", "cot")]


@query("d35_baselines", sql(f"SELECT coalesce(model, 'mean') AS model, {', '.join(f'round(avg({s}_{c}), 6) AS {s}_{c}' for s, c in _BASE)} FROM (SELECT model, {', '.join(f'''avg({s}) FILTER (condition = '{c}') AS {s}_{c}''' for s, c in _BASE)} FROM scored WHERE model <> 'm4' GROUP BY model) GROUP BY ROLLUP (model)", "ft", "fs"))
def _(spark, d):
    s = match.scored(records(spark, d).filter("model <> 'm4'"), tuple((*ALL[n], n) for n in ("ft", "fs")))
    per = s.groupBy("model").agg(*[F.avg(F.when(F.col("condition") == c, F.col(n))).alias(f"{n}_{c}") for n, c in _BASE])
    return per.rollup("model").agg(*[r6(F.avg(f"{n}_{c}")).alias(f"{n}_{c}") for n, c in _BASE]).withColumn("model", F.coalesce("model", F.lit("mean")))


@query("d36_tool_reliability", sql("SELECT model, condition, count(*) FILTER (tool) || '/' || count(*) AS fired, round(100.0 * count(*) FILTER (tool) / count(*), 6) AS pct, round(avg(CASE WHEN turns = 0 THEN 1 ELSE turns END), 6) AS mean_turns FROM records WHERE condition IN ('with_tools', 'with_skills') GROUP BY ALL"))
def _(spark, d):
    return rounded(A.tool_reliability(records(spark, d)))


TYPES = ["EMAIL_ADDRESS", "LOCATION", "PERSON", "PHONE_NUMBER"]


@query("d38_recall_pivot", counts_sql(f"SELECT model, condition, {', '.join(f'''round(coalesce(max(recall) FILTER (type = '{t}'), 0), 6) AS {t.lower()}''' for t in TYPES)} FROM ({MICRO}) GROUP BY ALL"))
def _(spark, d):
    w = A.recall_micro(A.type_counts(records(spark, d))).groupBy("model", "condition").pivot("type", TYPES).agg(F.max("recall")).na.fill(0.0)
    return w.select("model", "condition", *[r6(t).alias(t.lower()) for t in TYPES])


@query("d39_skills_by_type", counts_sql(f"SELECT model, type, round(max(recall) FILTER (condition = 'with_skills') - max(recall) FILTER (condition = 'zero_shot'), 6) AS gain FROM ({MACRO}) GROUP BY ALL"))
def _(spark, d):
    rec = A.recall_macro(A.type_counts(records(spark, d).filter(F.col("condition").isin("with_skills", "zero_shot"))))
    side = lambda c: F.max(F.when(F.col("condition") == c, F.col("recall")))
    return rec.groupBy("model", "type").agg(r6(side("with_skills") - side("zero_shot")).alias("gain"))


@query("e2_first_seen", sql("SELECT key, model, condition FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY model, condition) AS rn FROM records) WHERE rn = 1"))
def _(spark, d):
    first = records(spark, d).groupBy("key").agg(F.min(F.struct("model", "condition")).alias("f"))
    return first.select("key", "f.model", "f.condition")


@query("e5_gold_ranks", sql("SELECT key, type, max(rn) AS last FROM (SELECT key, g.type AS type, row_number() OVER (PARTITION BY key, g.type ORDER BY g.start) AS rn FROM (SELECT key, unnest(gold0) AS g FROM cards)) GROUP BY ALL"))
def _(spark, d):
    from pyspark.sql import Window

    from spanmill.plans.fixtures import cards

    flat = cards(spark, d).select("key", F.explode("gold0").alias("g")).select("key", "g.type", "g.start")
    return flat.withColumn("rn", F.row_number().over(Window.partitionBy("key", "type").orderBy("start"))).groupBy("key", "type").agg(F.max("rn").cast("long").alias("last"))


@query("f2_multi_sort", sql("SELECT model, condition, round(avg(fs), 6) AS f1 FROM scored GROUP BY ALL ORDER BY f1 DESC, model, condition LIMIT 10", "fs"))
def _(spark, d):
    m = match.scored(records(spark, d), (("span", "full", "fs"),)).groupBy("model", "condition").agg(r6(F.avg("fs")).alias("f1"))
    return m.orderBy(F.desc("f1"), "model", "condition").limit(10)


@query("f3_key_sorted", sql("SELECT condition, count(*) AS n FROM records GROUP BY condition ORDER BY condition"))
def _(spark, d):
    return records(spark, d).groupBy("condition").agg(F.count("*").alias("n")).orderBy("condition")


# ---- statistics ----


@query("i4_paired_t", deltas_sql("SELECT model, comparison, count(*) AS n, round(avg(delta) / nullif(stddev_samp(delta) / sqrt(count(*)), 0), 6) AS t FROM deltas GROUP BY ALL"))
def _(spark, d):
    return deltas(spark, d).agg(F.count("*").alias("n"), r6(stats.t_statistic(F.col("delta"))).alias("t"))


@query("i4_paired_t_p_values")
def _(spark, d):
    agg = deltas(spark, d).agg(F.count("*").alias("n"), stats.t_statistic(F.col("delta")).alias("t"))
    return stats.with_t(agg.coalesce(1), "n", "t").select("model", "comparison", "n", r6("t").alias("t"), "p", spans.p_value(F.col("p")).alias("p_text"))


@query("i5_cohens_d", deltas_sql("SELECT model, comparison, round(coalesce(avg(delta) / nullif(stddev_samp(delta), 0), 0), 6) AS d FROM deltas GROUP BY ALL"))
def _(spark, d):
    return deltas(spark, d).agg(r6(stats.cohens_d(F.col("delta"))).alias("d"))


@query("i5b_cohens_d_population", deltas_sql("SELECT model, comparison, round(avg(delta) / CASE WHEN stddev_pop(delta) = 0 THEN 1e-9 ELSE stddev_pop(delta) END, 6) AS d FROM deltas GROUP BY ALL"))
def _(spark, d):
    return deltas(spark, d).agg(r6(stats.cohens_d_population(F.col("delta"))).alias("d"))


@query("i6_normal_margin", deltas_sql("SELECT model, comparison, round(avg(delta), 6) AS mean, round(1.96 * stddev_pop(delta) / sqrt(count(*)), 6) AS margin FROM deltas GROUP BY ALL"))
def _(spark, d):
    return deltas(spark, d).agg(r6(F.avg("delta")).alias("mean"), r6(stats.normal_margin(F.col("delta"))).alias("margin"))


@query("i7_share_improved", deltas_sql("SELECT comparison, round(100.0 * count(*) FILTER (delta > 0) / count(*), 6) AS pct FROM deltas GROUP BY ALL"))
def _(spark, d):
    return A.paired(sc(spark, d, "fs"), "fs", PAIRS).groupBy("comparison").agg(r6(stats.share_positive(F.col("delta"))).alias("pct"))


@query("i8_safe_correlation", sql("SELECT model, condition, round(covar_pop(fs, turns) / nullif(stddev_pop(fs) * stddev_pop(turns), 0), 6) AS f1_turns, round(covar_pop(fs, elapsed) / nullif(stddev_pop(fs) * stddev_pop(elapsed), 0), 6) AS f1_elapsed FROM scored GROUP BY ALL", "fs"))
def _(spark, d):
    s = match.scored(records(spark, d), (("span", "full", "fs"),))
    return s.groupBy("model", "condition").agg(r6(stats.safe_corr(F.col("fs"), F.col("turns"))).alias("f1_turns"), r6(stats.safe_corr(F.col("fs"), F.col("elapsed"))).alias("f1_elapsed"))


@query("i9_ranges", deltas_sql("SELECT comparison, round(min(abs(m)), 6) AS low, round(max(abs(m)), 6) AS high, round(min(abs(d)), 6) AS d_low, round(max(abs(d)), 6) AS d_high FROM (SELECT model, comparison, 100 * avg(delta) AS m, avg(delta) / nullif(stddev_samp(delta), 0) AS d FROM deltas GROUP BY ALL) GROUP BY comparison"))
def _(spark, d):
    per = deltas(spark, d).agg((100 * F.avg("delta")).alias("m"), stats.cohens_d(F.col("delta")).alias("e"))
    return per.groupBy("comparison").agg(r6(F.min(F.abs("m"))).alias("low"), r6(F.max(F.abs("m"))).alias("high"), r6(F.min(F.abs("e"))).alias("d_low"), r6(F.max(F.abs("e"))).alias("d_high"))


_APPENDIX = "SELECT model, comparison, round(avg(delta) / nullif(stddev_samp(delta) / sqrt(count(*)), 0), 2) AS t, round(avg(delta) / CASE WHEN stddev_pop(delta) = 0 THEN NULL ELSE stddev_pop(delta) END, 3) AS d, round(100.0 * count(*) FILTER (delta > 0) / count(*), 1) AS pct FROM deltas GROUP BY model, comparison"


@query("i10_appendix_rows", deltas_sql(_APPENDIX))
def _(spark, d):
    return stats.appendix(deltas(spark, d)).drop("p", "line")


@query("i10_appendix_p")
def _(spark, d):
    return stats.appendix(deltas(spark, d)).select("model", "comparison", "p", "line")


# the t quantile by its expansion about the normal one, in powers of 1 / degrees of freedom
_Z = 1.959963984540054
_T = f"""({_Z} + {(_Z**3 + _Z) / 4} / v + {(5 * _Z**5 + 16 * _Z**3 + 3 * _Z) / 96} / (v * v) + {(3 * _Z**7 + 19 * _Z**5 + 17 * _Z**3 - 15 * _Z) / 384} / (v * v * v)
  + {(79 * _Z**9 + 776 * _Z**7 + 1482 * _Z**5 - 1920 * _Z**3 - 945 * _Z) / 92160} / (v * v * v * v))"""
_INTERVAL = f"s AS (SELECT model, condition, count(*) AS n, avg(fs) AS mean, stddev_samp(fs) AS sd, count(*) - 1.0::DOUBLE AS v FROM scored GROUP BY ALL), t AS (SELECT *, {_T} * sd / sqrt(n) AS margin, ceil(pow({_T} * sd / 0.02, 2))::BIGINT AS need FROM s)"


def _interval_sql(body: str) -> str:
    return f"WITH {scored_sql([(*ALL['fs'], 'fs')])}, {_INTERVAL} {body}"


@query("i1_t_interval", _interval_sql("SELECT model, condition, n, round(mean, 6) AS mean, round(margin, 6) AS margin, round(mean - margin, 6) AS low, round(mean + margin, 6) AS high FROM t"))
def _(spark, d):
    out = stats.confidence(match.scored(records(spark, d), (("span", "full", "fs"),)), ["model", "condition"], "fs")
    return rounded(out.select("model", "condition", "n", "mean", "margin", "low", "high"))


@query("i2_sample_adequacy", _interval_sql("SELECT model, condition, n, margin <= 0.02 AS enough, CASE WHEN margin <= 0.02 THEN n ELSE need END AS required_if_short, CASE WHEN margin <= 0.02 THEN need ELSE greatest(n + 1, need) END AS required_always FROM t"))
def _(spark, d):
    out = stats.confidence(match.scored(records(spark, d), (("span", "full", "fs"),)), ["model", "condition"], "fs")
    return out.select("model", "condition", "n", "enough", "required_if_short", "required_always")


@query("i3_bootstrap")
def _(spark, d):
    s = match.scored(records(spark, d), (("span", "full", "fs"),))
    return rounded(stats.bootstrap(s, ["model", "condition"], "fs", "key"))


@query("h22_p_value", "SELECT doc_id, p, CASE WHEN p < 0.001 THEN '< 0.001' ELSE printf('%.3f', p) END AS shown FROM (SELECT doc_id, (doc_id * 37 % 4001) / 4001.0::DOUBLE AS p FROM documents)")
def _(spark, d):
    p = (F.col("doc_id") * 37 % 4001) / F.lit(4001.0)
    return table(spark, d, "documents").select("doc_id", p.alias("p")).withColumn("shown", spans.p_value(F.col("p")))
