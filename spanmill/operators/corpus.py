"""Compiling labelled corpora: normalising, excluding, sampling, topping up, and joining texts back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanmill.functions import labels, spans, text


def equals_folded(c: Column, value: str) -> Column:
    """Whether a value equals `value` but for case and outer blanks; null counts as empty."""
    return F.lower(F.trim(F.coalesce(c, F.lit("")))) == value


def first_label(item: Column) -> Column:
    """The first non-empty of the keys a corpus may use for a label, of a variant object; UNK without one."""
    got = [F.nullif(F.try_variant_get(item, f"$.{k}", "string"), F.lit("")) for k in ("label", "entity_type", "category")]
    return F.coalesce(*got, F.lit("UNK"))


def normalise_masks(df: DataFrame, masks: str = "masks", prefix: str = "a_", index: str = "original_index") -> DataFrame:
    """Corpus A: array<struct<label,...>> to gold types; id from the row's index."""
    return df.withColumns({"id": F.concat(F.lit(prefix), F.col(index)), "types": F.transform(masks, lambda m: F.coalesce(m["label"], F.lit("UNK")))})


def normalise_spans(df: DataFrame, raw: str = "spans", prefix: str = "b_", index: str = "original_index") -> DataFrame:
    """Corpus B: a list of objects as JSON or Python literal, with one of three label keys."""
    return df.withColumns({"id": F.concat(F.lit(prefix), F.col(index)), "types": F.transform(text.lenient_list(F.col(raw)), first_label)})


def normalise_entities(df: DataFrame, entities: str = "entities", prefix: str = "c_", index: str = "original_index") -> DataFrame:
    """Corpus C: array<struct<entity, types array>>, one gold type for each type of each entity."""
    return df.withColumns({"id": F.concat(F.lit(prefix), F.col(index)), "types": F.flatten(F.transform(entities, lambda e: e["types"]))})


def mapped_types(types: Column) -> Column:
    return F.transform(types, labels.strict)


def compilable(types: Column) -> Column:
    """At least one gold label, and all of them in the base table."""
    return (F.size(types) > 0) & F.forall(mapped_types(types), lambda t: t.isNotNull())


def compiled(df: DataFrame, types: str = "types") -> DataFrame:
    """Rows whose gold is complete and mappable, without their text; with the mapped labels beside the own ones."""
    kept = df.filter(compilable(F.col(types)))
    return kept.select("id", "source", "original_index", F.col(types).alias("ground_truth"), mapped_types(F.col(types)).alias("canonical"))


def order_of(key: str, seed: int) -> Column:
    """A fixed shuffle: the order of these digests, the same in every engine."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")).cast("binary"))


def stratified_sample(df: DataFrame, n: int, strata: list[Column], key: str, seed: int = 42) -> DataFrame:
    """n rows: of each stratum its share, one at least, then the rest in the order of the shuffle.

    A share is min(size, max(1, floor(n size / total))). n or fewer rows come back as they are. Each task keeps
    the first n of a stratum before anything is shuffled, so a hot stratum is no larger than tasks x n.
    """
    names = [f"__s{i}" for i in range(len(strata))]
    base = df.withColumns(dict(zip(names, strata, strict=True))).withColumn("__o", order_of(key, seed))
    sizes = base.groupBy(*names).agg(F.count("*").alias("__size"))
    total = sizes.agg(F.sum("__size").alias("__total"))
    rank = F.row_number().over(Window.partitionBy(*names).orderBy("__o", key))
    first = base.withColumn("__rank", rank).filter(F.col("__rank") <= n)
    same = F.lit(True)
    for s in names:
        same = same & F.col(f"l.{s}").eqNullSafe(F.col(f"r.{s}"))
    joined = first.alias("l").join(sizes.alias("r"), same).select("l.*", "r.__size").crossJoin(F.broadcast(total))  # one row
    share = F.least(F.col("__size"), F.greatest(F.lit(1), F.floor(F.lit(n) * F.col("__size") / F.col("__total"))))
    picked = joined.withColumn("__fill", F.col("__rank") > share)
    return picked.orderBy("__fill", "__o", key).limit(n).select(*df.columns)


def capped(df: DataFrame, cap: int, order: list[str]) -> DataFrame:
    """The first `cap` rows in the given order; each task keeps no more than that."""
    return df.orderBy(*order).limit(cap)


def balanced(df: DataFrame, cap: int, source: str, order: list[str]) -> DataFrame:
    """At most cap rows, taken from the sources in turn."""
    turn = df.withColumn("__turn", F.row_number().over(Window.partitionBy(source).orderBy(*order))).filter(F.col("__turn") <= cap)
    return turn.orderBy("__turn", source).limit(cap).drop("__turn")


def hydrated(bench: DataFrame, corpus: DataFrame, keys: tuple = ("source", "original_index")) -> DataFrame:
    """bench with the corpus's columns; rows whose text is gone are dropped, empty texts stay."""
    return bench.join(corpus, list(keys)).filter(F.col("text").isNotNull())


def topped_up(have: DataFrame, extra: DataFrame, target: int, order: list[str], keys: tuple = ("source", "original_index")) -> DataFrame:
    """have, and rows of extra that are not in it, in order, until there are `target`."""
    need = max(0, target - have.count())
    return have.unionByName(extra.join(have.select(*keys), list(keys), "left_anti").orderBy(*order).limit(need))


def merged(saved: DataFrame, fresh: DataFrame, keys: tuple = ("model", "condition")) -> DataFrame:
    """saved without the groups that fresh holds, and fresh."""
    return saved.join(fresh.select(*keys).distinct(), list(keys), "left_anti").unionByName(fresh)


def unique(df: DataFrame, *keys: str) -> DataFrame:
    """n_rows, n_keys and whether they agree; null keys count as keys."""
    per = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_keys")).withColumn("is_unique", F.col("n_rows") == F.col("n_keys"))


def length_stats(df: DataFrame, by: str, n_types: Column, n_mapped: Column, body: str = "text") -> DataFrame:
    """Per source: rows, gold, mapped gold, characters and words, with means and medians, and the share of rows."""
    chars, words = F.length(F.coalesce(F.col(body), F.lit(""))), spans.word_count(F.col(body))
    base = df.select(by, n_types.alias("g"), n_mapped.alias("m"), chars.alias("c"), words.alias("w"))
    agg = [F.count("*").alias("n_samples"), F.sum("g").alias("total_pii"), F.sum("m").alias("total_canonical")]
    for c, name in (("g", "pii"), ("m", "canonical"), ("c", "chars"), ("w", "words")):
        agg += [F.avg(c).alias(f"mean_{name}"), F.percentile(c, F.lit(0.5)).alias(f"median_{name}")]
    out = base.groupBy(by).agg(*agg)
    total = F.sum("n_samples").over(Window.partitionBy())
    return out.withColumn("pct_of_total", 100 * F.col("n_samples") / total)
