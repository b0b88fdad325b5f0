"""One-to-one matching of predictions with gold, within a record, without a shuffle.

Records hold arrays `preds` and `gold` of structs (type, text, start, stop). Matching is greedy in the order
of the predictions: each takes the first gold that is unused, has an equal label and passes the mode's test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.functions import labels, spans
from spanmill.functions.text import bound

LEAST_IOU = 0.5


def _test(mode: str, p: Column, g: Column) -> Column:
    if mode == "type":
        return F.lit(True)
    bare = ~spans.has_span(g["start"], g["stop"])
    if mode == "strict":
        return bare | ((p["start"] == g["start"]) & (p["stop"] == g["stop"]))
    return bare | (spans.iou(p["start"], p["stop"], g["start"], g["stop"]) >= LEAST_IOU)


def normalised(items: Column, how: str) -> Column:
    label = lambda s: bound(labels.key(s["type"]), lambda k: labels.by_key(k, how))
    return F.transform(items, lambda s: F.struct(label(s).alias("type"), s["start"].alias("start"), s["stop"].alias("stop")))


def eligible(preds: Column, gold: Column, mode: str) -> Column:
    """For each prediction the places (from 0) in gold that it may take, in order."""
    places = F.when(F.size(gold) > 0, F.sequence(F.lit(0), F.size(gold) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(preds, lambda p: F.filter(places, lambda i: (F.get(gold, i)["type"] == p["type"]) & _test(mode, p, F.get(gold, i))))


def taken(options: Column) -> Column:
    """The places taken when each prediction in turn takes its first free option."""
    free = lambda used, own: F.filter(own, lambda i: ~F.array_contains(used, i))
    return F.aggregate(options, F.array().cast("array<int>"), lambda used, own: F.concat(used, F.slice(free(used, own), 1, 1)))


def type_matches(preds: Column, gold: Column) -> Column:
    """Greedy matching by label alone has a closed form: the sum of the smaller counts of each label."""
    count = lambda items, t: F.size(F.filter(items, lambda u: u == t))

    def both(held: Column) -> Column:
        return F.aggregate(F.array_distinct(held["g"]), F.lit(0), lambda n, t: n + F.least(count(held["p"], t), count(held["g"], t)))

    return bound(F.struct(preds["type"].alias("p"), gold["type"].alias("g")), both)


def _true_positives(step: DataFrame, mode: str, p: str, g: str, out: str) -> DataFrame:
    """step with the number of true positives of a mode between its normalised columns p and g."""
    if mode == "type":
        return step.withColumn(out, type_matches(F.col(p), F.col(g)).cast("long"))
    step = step.withColumn("__o", eligible(F.col(p), F.col(g), mode))
    return step.withColumn(out, F.size(taken(F.col("__o"))).cast("long")).drop("__o")


def matched(records: DataFrame, mode: str = "span", how: str = "full", out: str = "tp") -> DataFrame:
    """records with the number of true positives of a mode (type, span or strict) under a label map."""
    step = records.withColumns({"__p": normalised(F.col("preds"), how), "__g": normalised(F.col("gold"), how)})
    return _true_positives(step, mode, "__p", "__g", out).drop("__p", "__g")


def scored(records: DataFrame, modes: tuple = (("type", "full", "f1_type"),)) -> DataFrame:
    """records with n_pred, n_gold and an F1 for each (mode, map, name); P and R too for a name ending in "+".

    Labels are mapped once a map, whatever the number of its modes.
    """
    out = records.withColumns({"n_pred": F.size("preds").cast("long"), "n_gold": F.size("gold").cast("long")})
    for how in dict.fromkeys(m[1] for m in modes):
        out = out.withColumns({"__p": normalised(F.col("preds"), how), "__g": normalised(F.col("gold"), how)})
        for mode, _, name in (m for m in modes if m[1] == how):
            out = _true_positives(out, mode, "__p", "__g", f"tp_{name.rstrip('+')}")
        out = out.drop("__p", "__g")
    for _, _, name in modes:
        bare = name.rstrip("+")
        args = (F.col(f"tp_{bare}"), F.col("n_pred"), F.col("n_gold"))
        out = out.withColumn(bare, spans.f1(*args))
        if name.endswith("+"):
            out = out.withColumns({f"p_{bare}": spans.precision(*args), f"r_{bare}": spans.recall(*args)})
    return out


def gold_hits(records: DataFrame, how: str, by: str, mode: str = "type") -> DataFrame:
    """One row a gold span: its label under map `by`, and whether it is taken when matching under map `how`."""
    step = records.withColumns({"__p": normalised(F.col("preds"), how), "__g": normalised(F.col("gold"), how)})
    step = step.withColumn("__t", taken(eligible(F.col("__p"), F.col("__g"), mode)))
    flat = step.select("model", "condition", "key", "__t", F.posexplode(normalised(F.col("gold"), by)).alias("at", "g"))
    return flat.select("model", "condition", "key", F.col("g.type").alias("type"), F.array_contains("__t", F.col("at")).alias("hit"))


def funnel(records: DataFrame, how: str = "full") -> DataFrame:
    """Per record the gold with offsets, and how many of it were named, overlapped, located and met exactly.

    Every prediction is compared with the first gold of its label only, used or not.
    """
    step = records.withColumns({"__p": normalised(F.col("preds"), how), "__g": F.filter(normalised(F.col("gold"), how), lambda g: spans.has_span(g["start"], g["stop"]))})
    step = step.withColumn("__o", F.transform("__p", lambda p: F.struct(p.alias("p"), F.array_position(F.transform("__g", lambda g: g["type"]), p["type"]).cast("int").alias("at"))))
    step = step.withColumn("__o", F.transform(F.filter("__o", lambda o: o["at"] > 0), lambda o: F.struct(o["p"].alias("p"), o["at"].alias("at"), F.get("__g", o["at"] - 1).alias("g"))))
    v = lambda o: spans.iou(o["p"]["start"], o["p"]["stop"], o["g"]["start"], o["g"]["stop"])
    tests = {"named": lambda o: F.lit(True), "overlapped": lambda o: v(o) > 0, "located": lambda o: v(o) >= LEAST_IOU, "exact": lambda o: (o["p"]["start"] == o["g"]["start"]) & (o["p"]["stop"] == o["g"]["stop"])}
    many = {n: F.size(F.array_distinct(F.transform(F.filter("__o", t), lambda o: o["at"]))).cast("long") for n, t in tests.items()}
    return step.withColumns({"gold_spans": F.size("__g").cast("long"), **many}).drop("__p", "__g", "__o")


def true_funnel(records: DataFrame, how: str = "full") -> DataFrame:
    """As funnel(), but a gold counts for a stage if any prediction of its label passes the stage's test."""
    step = records.withColumns({"__p": normalised(F.col("preds"), how), "__g": F.filter(normalised(F.col("gold"), how), lambda g: spans.has_span(g["start"], g["stop"]))})
    v = lambda p, g: spans.iou(p["start"], p["stop"], g["start"], g["stop"])
    tests = {"named": lambda p, g: F.lit(True), "overlapped": lambda p, g: v(p, g) > 0, "located": lambda p, g: v(p, g) >= LEAST_IOU, "exact": lambda p, g: (p["start"] == g["start"]) & (p["stop"] == g["stop"])}

    def passing(test):
        return F.size(F.filter("__g", lambda g: F.exists("__p", lambda p: (p["type"] == g["type"]) & test(p, g)))).cast("long")

    many = {n: passing(t) for n, t in tests.items()}
    return step.withColumns({"gold_spans": F.size("__g").cast("long"), **many}).drop("__p", "__g")


def label_pairs(records: DataFrame, known: list[str]) -> DataFrame:
    """How often a prediction's label that is in no table occurs beside each distinct gold label of its record."""
    odd = F.filter(F.transform("preds", lambda p: labels.key(p["type"])), lambda k: ~k.isin(*known))
    gold = F.array_distinct(F.filter(F.transform("gold", lambda g: labels.strict(g["type"])), lambda t: t.isNotNull()))
    flat = records.select(F.explode(odd).alias("label"), gold.alias("g")).select("label", F.explode("g").alias("gold_type"))
    return flat.groupBy("label", "gold_type").agg(F.count("*").alias("n"))
