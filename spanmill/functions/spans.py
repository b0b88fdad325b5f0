"""Scalar functions on spans, texts and scores, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<type:string,text:string,start:int,stop:int>"


def offset(raw: Column) -> Column:
    """Lenient offset: an integer with blanks and sign around it; anything else, and null, is 0."""
    return F.coalesce(F.trim(raw.cast("string")).try_cast("int"), F.lit(0))


def offset_digits(raw: Column) -> Column:
    """Strict offset: digits after any number of minus signs, without blanks or plus; else 0."""
    s = raw.cast("string")
    return F.when(s.rlike(r"\A-*[0-9]+\z"), F.coalesce(s.try_cast("int"), F.lit(0))).otherwise(0)


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Intersection over union of two half-open ranges, 0 where the union is empty."""
    inter = overlap(s1, e1, s2, e2)
    union = (e1 - s1) + (e2 - s2) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def has_span(start: Column, stop: Column) -> Column:
    return (F.coalesce(start, F.lit(0)) != 0) | (F.coalesce(stop, F.lit(0)) != 0)


def any_span(gold: Column) -> Column:
    return F.coalesce(F.exists(gold, lambda g: has_span(g["start"], g["stop"])), F.lit(False))


def precision(tp: Column, n_pred: Column, n_gold: Column) -> Column:
    empty = F.when(n_pred == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(n_gold == 0, empty).when(n_pred == 0, F.lit(0.0)).otherwise(F.try_divide(tp, n_pred))


def recall(tp: Column, n_pred: Column, n_gold: Column) -> Column:
    """1 where there is no gold, whatever was predicted."""
    return F.when(n_gold == 0, F.lit(1.0)).when(n_pred == 0, F.lit(0.0)).otherwise(F.try_divide(tp, n_gold))


def f1(tp: Column, n_pred: Column, n_gold: Column) -> Column:
    """2PR/(P+R) without rounding; without gold 1 if nothing was predicted, else 0."""
    return F.when(n_gold == 0, F.when(n_pred == 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(2.0 * tp / (n_pred + n_gold))


def length_bin(text: Column) -> Column:
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n < 500, "short").when(n < 2000, "medium").otherwise("long")


def type_signature(types: Column) -> Column:
    """The first three distinct types in order, joined by bars; "none" without any, missing ones are UNK."""
    known = F.transform(types, lambda t: F.coalesce(t, F.lit("UNK")))
    return F.when(F.coalesce(F.size(types), F.lit(0)) <= 0, "none").otherwise(F.array_join(F.slice(F.array_sort(F.array_distinct(known)), 1, 3), "|"))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")).cast("long")


def p_value(p: Column) -> Column:
    return F.when(p < 0.001, "< 0.001").otherwise(F.format_string("%.3f", p))


def redacted(spans: Column) -> Column:
    """Spans whose text, where they have one, is hidden."""
    return F.transform(spans, lambda s: s.withField("text", F.when(s["text"].isNotNull(), "[REDACTED]")))


def redact_text(text: Column, spans: Column) -> Column:
    """[TYPE] in place of each span, from the last start to the first; offsets of overlapping spans go stale."""
    last_first = F.reverse(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["type"].alias("type")))))

    def splice(t: Column, s: Column) -> Column:
        return F.concat(F.substring(t, F.lit(1), s["start"]), F.lit("["), s["type"], F.lit("]"), F.substring(t, s["stop"] + 1, F.length(t)))

    return F.aggregate(last_first, text, splice)


def redact_merged(text: Column, spans: Column) -> Column:
    """As redact_text, but overlapping spans are first merged into one that bears the type of the earliest."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["type"].alias("type"))))
    kind = "array<struct<start:int,stop:int,type:string>>"

    def merge(out: Column, s: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        joined = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"), last["type"].alias("type"))))
        return F.when((F.size(out) > 0) & (s["start"] < last["stop"]), joined).otherwise(F.array_append(out, s))

    return redact_text(text, F.aggregate(ordered, F.array().cast(kind), merge))
