"""Mixing sources to target weights by hash thresholds.

A source's budget is a share of all words by weight, at most REPEATS times its own. Every document has a hash of its id and text.
What a source takes is a threshold of that hash: with a budget below its size, the documents under the threshold once; with a larger
one, all documents once and those under the threshold once more. Thresholds are nested: a smaller budget takes a part of what a larger one
takes.

A threshold is found by histograms: words by source and hash bucket, added up in order, show the bucket in which the budget ends.
Only the rows of that bucket are dealt into finer buckets, until it holds one hash; nothing is sorted. Rows that share it are equal
documents; as many of them are taken as come nearest, told apart by a histogram of their row numbers in the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanmill.llm.common import cut, discard, drop_clashing, n_words, running

#: Weights of the sources in order, repeating; words of the mix as a share of all; most times that a document is taken.
WEIGHTS, SHARE, REPEATS = (3, 1, 2), 1.5, 2
#: Bits of a document's hash; buckets of a histogram.
HASH_BITS, BUCKETS = 60, 4096
LAST = (1 << 63) - 1


#: Columns that this module adds to the documents.
OWN = ("__size", "__h", "__row")


def sized(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """docs with __size (words), __h (hash of key and text) and __row (a number that stays once it is stored)."""
    digest = F.md5(F.concat(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")))))
    h = F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")
    return drop_clashing(docs, *OWN).withColumns({"__size": n_words(F.col(f"`{text}`")), "__h": h, "__row": F.monotonically_increasing_id()})


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """sizes (source, source_size) with a target each: its share by weight of all words; what exceeds `repeats` times a size is
    reshared by weight until none does.

    A round costs one pass over the sources and brings two numbers to the driver.
    """
    ranked = running(sizes, [], [F.col("source").asc_nulls_last()], "place")
    w = F.get(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights)).cast("int"))
    held = cut(ranked.withColumn("weight", w), "sources")
    most = repeats * F.col("source_size")
    whole = share * (held.agg(F.sum("source_size")).head()[0] or 0)
    level, stopped = 0.0, -1
    while True:
        over = F.lit(False) if stopped < 0 else F.col("weight") * F.lit(level) > most
        n, spent, left = held.agg(F.count_if(over), F.sum(F.when(over, most).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight")))).head()
        if n == stopped or not left:
            break
        stopped, level = n, (whole - (spent or 0)) / left
    return held.select("source", "source_size", F.least(F.col("weight") * F.lit(level), most.cast("double")).alias("target"))


def _boundaries(rows: DataFrame, state: DataFrame) -> DataFrame:
    """For each source of state (source, budget, before, lo, width) the bucket of rows (source, k, size) in which its budget ends:
    budget, before (words of lower buckets), n, s, lo, hi. A source whose rows do not use up its budget has none."""
    own = state.select(F.col("source").alias("__source"), "budget", "before", "lo", "width")
    dealt = rows.join(own, F.col("source").eqNullSafe(F.col("__source"))).withColumn("bucket", F.expr("(k - lo) div width"))
    counts = dealt.groupBy("source", "budget", "before", "bucket").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi"))
    order = Window.partitionBy("source").orderBy("bucket")  # at most BUCKETS rows a source
    upto = counts.withColumn("upto", F.col("before") + F.sum("s").over(order))
    crossed = upto.filter("upto > budget and upto - s <= budget and s > 0")
    return crossed.select("source", "budget", (F.col("upto") - F.col("s")).alias("before"), "n", "s", "lo", "hi")


def _refined(rows: DataFrame, state: DataFrame) -> DataFrame:
    """_boundaries() of a single k for each source, found by ever finer buckets."""
    done = None
    while True:
        found = cut(_boundaries(rows, state), "boundaries")
        single = found.filter("lo = hi")
        done = single if done is None else done.unionByName(single)
        wide = found.filter("lo < hi")
        if wide.limit(1).count() == 0:
            return done
        state = wide.select("source", "budget", "before", "lo", F.expr(f"(hi - lo) div {BUCKETS} + 1").alias("width"))
        own = wide.select(F.col("source").alias("__source"), F.col("lo").alias("__lo"), F.col("hi").alias("__hi"))
        rows = cut(rows.join(own, F.expr("source <=> __source and k between __lo and __hi")).select("source", "k", "size"), "bucket")


def thresholds(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """source, source_size, target, base, leaf, upto: a document is taken base times, and once more if its hash is below leaf, or
    equal to it and its row is below upto."""
    base = (F.col("target") > F.col("source_size")).cast("int")
    wanted = wanted.withColumn("base", base).withColumn("budget", F.when(F.col("base") == 1, F.col("target") - F.col("source_size")).otherwise(F.col("target")))
    zero = wanted.select("source", "budget", F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("lo"), F.lit((1 << HASH_BITS) // BUCKETS).alias("width"))
    leaf = _refined(stored.select("source", F.col("h").alias("k"), "size"), zero)
    each = F.col("s") / F.col("n")
    leaf = cut(leaf.select("source", F.col("lo").alias("leaf"), "n", F.floor((2.0 * (F.col("budget") - F.col("before")) + each) / (2.0 * each)).alias("m")), "leaf")
    some = leaf.filter("m > 0 and m < n")
    if some.limit(1).count():
        own = some.select(F.col("source").alias("__source"), "leaf")
        copies = cut(stored.join(own, F.expr("source <=> __source and h = leaf")).select("source", F.col("row").alias("k"), F.lit(1).cast("long").alias("size")), "copies")
        state = copies.groupBy("source").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).withColumn("width", F.expr(f"(hi - lo) div {BUCKETS} + 1"))
        state = state.join(some.select(F.col("source").alias("__source"), F.col("m").cast("double").alias("budget")), F.expr("source <=> __source")).select("source", "budget", F.lit(0).cast("long").alias("before"), "lo", "width")
        cuts = _refined(copies, state).select(F.col("source").alias("__source"), F.col("lo").alias("cut"))
    else:
        cuts = leaf.filter("false").select(F.col("source").alias("__source"), F.col("leaf").alias("cut"))
    upto = F.when(F.col("m") <= 0, 0).when(F.col("m") >= F.col("n"), LAST).otherwise(F.col("cut"))
    ends = leaf.join(cuts, F.expr("source <=> __source"), "left").select(F.col("source").alias("__s"), "leaf", upto.alias("upto"))
    both = wanted.join(ends, F.expr("source <=> __s"), "left")
    return both.select("source", "source_size", "target", "base", F.coalesce("leaf", F.lit(LAST)).alias("leaf"), F.coalesce("upto", F.lit(LAST)).alias("upto"))


def _told(stored: DataFrame, source: str) -> DataFrame:
    """stored with __source_size, __target and __copies."""
    narrow = stored.select(F.col(f"`{source}`").alias("source"), F.col("__size").alias("size"), F.col("__h").alias("h"), F.col("__row").alias("row"))
    sizes = cut(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), "sizes")
    told = cut(thresholds(narrow, targets(sizes)), "thresholds")
    discard(sizes)
    own = told.select(F.col("source").alias("__source"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), "base", "leaf", "upto")
    more = F.expr("__h < leaf or (__h = leaf and __row < upto)").cast("int")
    both = stored.join(own, F.col(f"`{source}`").eqNullSafe(F.col("__source"))).withColumn("__copies", F.col("base") + more)
    return both.select(*[F.col(f"`{c}`") for c in stored.columns], "__source_size", "__target", "__copies")


def plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """key, source, size, source_size, target and copies (0 to REPEATS times that the mix takes it) of every document.

    Null texts and texts without words have size 0; a null source is a source of its own, the last. Repeated rows are documents of
    their own; of equal ones it is all the same which are taken. The words taken differ from a source's target by at most half the size
    of the document at the threshold. An empty table gives no rows. Other columns, whatever their names, are not read.
    """
    stored = cut(sized(docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys((key, text, source))]), key, text, source).drop(text), "sized")
    return _told(stored, source).select(F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__copies").alias("copies"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: every row of docs as often as plan() takes it, with all its columns (but those named as OWN)."""
    docs = drop_clashing(docs, *OWN)
    told = _told(cut(sized(docs, key, text, source), "sized"), source)
    return told.filter("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document, as plan() says; taken counts repeats."""
    found = plan(docs)
    return found.select(F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def _hash_sql(c: str) -> str:
    return f"('0x' || left(md5(concat(coalesce({c}::VARCHAR, ''), ':', md5(coalesce(text, '')))), {HASH_BITS // 4}))::BIGINT"


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, {_hash_sql("doc_id")} AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
r AS (SELECT *, coalesce(sum(2 * source_size) OVER o, 0)::DOUBLE AS spent, (sum(w) OVER () - coalesce(sum(w) OVER o, 0))::DOUBLE AS left_w, (1.5 * sum(source_size) OVER ())::DOUBLE AS whole FROM s
  WINDOW o AS (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT (whole - spent) / left_w AS lam FROM r WHERE w * ((whole - spent) / left_w) <= 2 * source_size ORDER BY source_size::DOUBLE / w, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, least(w * (SELECT lam FROM l), 2.0::DOUBLE * source_size) AS target FROM s),
b AS (SELECT *, (target > source_size)::INTEGER AS base, CASE WHEN target > source_size THEN target - source_size ELSE target END AS budget FROM t),
g AS (SELECT source, h, sum(size)::BIGINT AS gs, count(*) AS n FROM d GROUP BY source, h),
c AS (SELECT source, h, gs, n, (sum(gs) OVER (PARTITION BY source ORDER BY h))::BIGINT AS upto FROM g),
k AS (SELECT c.source, c.h, b.source_size, b.target, b.base,
  CASE WHEN upto <= budget THEN n WHEN upto - gs > budget THEN 0 ELSE floor((2.0::DOUBLE * (budget - (upto - gs)) + gs::DOUBLE / n) / (2.0::DOUBLE * (gs::DOUBLE / n))) END AS m
  FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (size * (base + (rn <= m)::INTEGER))::BIGINT AS taken
FROM (SELECT *, row_number() OVER (PARTITION BY source, h) AS rn FROM d) d JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.h = k.h
"""
