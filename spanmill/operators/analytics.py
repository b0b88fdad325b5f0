"""Summaries of scored records: groups, pairs, pivots, recalls and funnels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanmill.functions import labels, spans
from spanmill.operators import match

GROUP = ["model", "condition"]


def run_summary(records: DataFrame) -> DataFrame:
    """Per run: records, errors, tool calls, seconds in total and on average."""
    return records.groupBy(*GROUP).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("error") != "").alias("errors"),
        F.count_if("tool").alias("tool_calls"),
        F.sum("elapsed").alias("total_seconds"),
        F.avg("elapsed").alias("mean_seconds"),
    )


def answer_summary(records: DataFrame) -> DataFrame:
    return records.groupBy(*GROUP).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("error") != "").alias("errors"),
        F.avg(F.size("preds")).alias("mean_preds"),
        F.avg(F.size("gold")).alias("mean_gold"),
        F.count_if("tool").alias("tool_calls"),
        F.count_if("skill").alias("skills_viewed"),
    )


def score_summary(scored: DataFrame, f: str, p: str, r: str) -> DataFrame:
    return scored.groupBy(*GROUP).agg(
        F.count("*").alias("n"),
        F.avg(f).alias("mean_f1"),
        F.avg(p).alias("mean_p"),
        F.avg(r).alias("mean_r"),
        F.percentile(f, F.lit(0.5)).alias("median_f1"),
        F.count_if("tool").alias("tool_calls"),
        F.avg("elapsed").alias("mean_seconds"),
        F.avg("turns").alias("mean_turns"),
    )


def pivoted(df: DataFrame, rows: list[str], value: str, conditions: list[str], agg=F.avg) -> DataFrame:
    """One column a condition; the conditions are given, so no job looks for them."""
    return df.groupBy(*rows).pivot("condition", conditions).agg(agg(value))


def paired(scored: DataFrame, value: str, comparisons: list[tuple[str, str]], key: str = "key") -> DataFrame:
    """model, key, comparison, delta: the value under the second condition minus that under the first.

    One aggregation by (model, key) instead of a self-join a comparison.
    """
    names = list(dict.fromkeys(c for pair in comparisons for c in pair))
    wide = pivoted(scored, ["model", key], value, names, F.max)
    deltas = F.array(*[F.struct(F.lit(f"{b} - {a}").alias("comparison"), (F.col(b) - F.col(a)).alias("delta")) for a, b in comparisons])
    return wide.select("model", key, F.explode(deltas).alias("d")).select("model", key, "d.comparison", "d.delta").filter("delta is not null")


def type_counts(records: DataFrame, how: str = "full") -> DataFrame:
    """model, condition, key, type, n_gold, n_pred: counts of each label of a record, from one pass."""
    one = lambda c, name: F.transform(F.transform(c, lambda s: labels.key(s["type"])), lambda k: F.struct(labels.by_key(k, how).alias("type"), F.lit(int(name == "gold")).alias("g"), F.lit(int(name == "pred")).alias("p")))
    flat = records.select(*GROUP, "key", F.explode(F.concat(one("gold", "gold"), one("preds", "pred"))).alias("s"))
    return flat.groupBy(*GROUP, "key", "s.type").agg(F.sum("s.g").alias("n_gold"), F.sum("s.p").alias("n_pred"))


def recall_macro(counts: DataFrame) -> DataFrame:
    """Per record and gold label min(n_pred / n_gold, 1), averaged."""
    has = counts.filter("n_gold > 0")
    return has.groupBy(*GROUP, "type").agg(F.avg(F.least(F.col("n_pred") / F.col("n_gold"), F.lit(1.0))).alias("recall"), F.sum("n_gold").alias("support"))


def recall_micro(counts: DataFrame) -> DataFrame:
    has = counts.filter("n_gold > 0")
    return has.groupBy(*GROUP, "type").agg(F.try_divide(F.sum(F.least("n_gold", "n_pred")), F.sum("n_gold")).alias("recall"))


def recall_by_maps(records: DataFrame, support: int = 50) -> DataFrame:
    """Recall a label when matching under the earlier map and under the aligned one; labels are the aligned ones."""
    both = match.gold_hits(records, "before", "full").withColumn("map", F.lit("before")).unionByName(match.gold_hits(records, "full", "full").withColumn("map", F.lit("after")))
    out = both.groupBy("type").agg(*[F.try_divide(F.count_if((F.col("map") == m) & F.col("hit")), F.count_if(F.col("map") == m)).alias(m) for m in ("before", "after")], (F.count("*") / 2).cast("long").alias("support"))
    return out.filter(F.col("support") >= support)


def over_prediction(records: DataFrame, k: int = 12) -> DataFrame:
    """Predicted count of a label over its count in the gold of distinct samples; infinite without gold."""
    step = match.normalised(F.col("preds"), "full"), match.normalised(F.col("gold"), "full")
    pred = records.select(F.explode(step[0]).alias("s")).groupBy("s.type").agg(F.count("*").alias("predicted"))
    gold = records.select("key", step[1].alias("g")).dropDuplicates(["key"]).select(F.explode("g").alias("s")).groupBy("s.type").agg(F.count("*").alias("support"))
    both = pred.join(gold, "type", "left").na.fill(0, ["support"])
    ratio = F.when(F.col("support") > 0, F.round(F.col("predicted") / F.col("support"), 1)).otherwise(F.lit(float("inf")))
    return both.withColumn("ratio", ratio).orderBy(F.desc("predicted"), "type").limit(k)


def relative(df: DataFrame, value: Column, base: Column) -> Column:
    """Per cent change against base, 0 where that is not positive."""
    return F.when(base > 0, 100 * (value - base) / base).otherwise(0.0)


def profile(scored: DataFrame, f: str, p: str, r: str) -> DataFrame:
    """Five means a run, scaled to 0..1 within a model: 0.5 where they are all equal; less time is better.

    Means are compared to nine places, so that the order of summation cannot make equal ones differ.
    """
    parts = {"f1": F.col(f), "precision": F.col(p), "recall": F.col(r), "speed": F.col("elapsed"), "tool_use": F.col("tool").cast("int")}
    means = scored.groupBy(*GROUP).agg(*[F.round(F.avg(c), 9).alias(n) for n, c in parts.items()])
    w = Window.partitionBy("model")

    def scale(c: str) -> Column:
        low, high = F.min(c).over(w), F.max(c).over(w)
        x = F.when(high > low, F.try_divide(F.col(c) - low, high - low)).otherwise(0.5)
        return 1 - x if c == "speed" else x

    return means.select(*GROUP, *[scale(c).alias(c) for c in ("f1", "precision", "recall", "speed", "tool_use")])


def funnel_table(records: DataFrame, how: str = "full", true: bool = False) -> DataFrame:
    """Per condition the gold with offsets and the shares of it that pass each stage."""
    step = (match.true_funnel if true else match.funnel)(records, how)
    stages = ["named", "overlapped", "located", "exact"]
    sums = step.groupBy("condition").agg(F.sum("gold_spans").alias("gold"), *[F.sum(s).alias(f"n_{s}") for s in stages])
    pct = [F.try_divide(100 * F.col(f"n_{s}"), F.col("gold")).alias(f"{s}_pct") for s in stages]
    more = [F.try_divide(100 * F.col("n_overlapped"), F.col("n_named")).alias("overlap_given_named"), F.try_divide(100 * F.col("n_exact"), F.col("n_overlapped")).alias("exact_given_overlap")]
    return sums.select("condition", "gold", *pct, *more)


def strata(records: DataFrame) -> DataFrame:
    """Per source: samples of a model, those with offsets, and their share."""
    base = records.filter(F.col("condition") == "zero_shot").groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("model").alias("models"), F.count_if(spans.any_span(F.col("gold"))).alias("with_spans"))
    return base.select("source", F.floor(F.col("n") / F.col("models")).alias("samples"), (F.col("with_spans") > 0).alias("span_bearing"), (100 * F.col("with_spans") / F.col("n")).alias("span_pct"))


def skill_split(scored: DataFrame, f: str) -> DataFrame:
    """Records of the skills condition by whether a skill was viewed; an empty side counts as 0."""
    own = scored.filter(F.col("condition") == "with_skills")
    viewed, other = F.avg(F.when(F.col("skill"), F.col(f))), F.avg(F.when(~F.col("skill"), F.col(f)))
    out = own.groupBy("model").agg(F.count("*").alias("n"), (F.count_if("skill") / F.count("*")).alias("rate"), F.coalesce(viewed, F.lit(0.0)).alias("f1_viewed"), F.coalesce(other, F.lit(0.0)).alias("f1_other"), viewed.alias("raw_viewed"), other.alias("raw_other"))
    return out.select("model", "n", "rate", "f1_viewed", "f1_other", (F.col("f1_viewed") - F.col("f1_other")).alias("difference"), (F.col("raw_viewed") - F.col("raw_other")).alias("difference_or_null"))


def tool_reliability(records: DataFrame) -> DataFrame:
    fired = F.count_if("tool")
    turns = F.when(F.coalesce("turns", F.lit(0)) == 0, 1).otherwise(F.col("turns"))
    base = records.filter(F.col("condition").isin("with_tools", "with_skills")).groupBy(*GROUP)
    return base.agg(F.concat_ws("/", fired, F.count("*")).alias("fired"), (100 * fired / F.count("*")).alias("pct"), F.avg(turns).alias("mean_turns"))


def date_labels(records: DataFrame, conditions: tuple = ("with_tools", "with_skills"), key: str = "key") -> DataFrame:
    """One row: gold labels DATE and DATE_TIME of each sample once, and results, predicted spans and spans a result of conditions."""
    gold = records.groupBy(key).agg(F.first("gold").alias("gold")).select(F.explode("gold").alias("g")).select(labels.key(F.col("g.type")).alias("k"))
    seen = gold.agg(F.count_if(F.col("k") == "DATE").alias("gold_dates"), F.count_if(F.col("k") == "DATE_TIME").alias("gold_date_times"))
    own = records.filter(F.col("condition").isin(*conditions)).agg(F.count(F.lit(1)).alias("n_results"), F.coalesce(F.sum(F.size("preds")), F.lit(0)).alias("n_spans"))
    both = seen.crossJoin(F.broadcast(own))  # a row each
    return both.withColumn("spans_a_result", F.round(F.try_divide("n_spans", "n_results"), 6))
