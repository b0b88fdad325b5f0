"""Trie of conversations: which conversations share their first turns, and what reading those once would save.

Construction goes level by level. At every depth the live conversations are grouped by (parent node, next turn); the group is a node,
named by its smallest conv_id. A node is open while its conversations differ as a whole (two position-keyed digests of all turns tell);
those of a closed node - a single one or copies of each other - leave the loop, as below it there is only a chain. So the loop
ends at the deepest branching, not at the longest conversation. Then leaves and savings roll up level by level from the deepest
open one; chains have a closed form from running sums of words.

Turns are told apart by the MD5 of role and text. Nothing gathers a group: nodes are counts, and the ids that end at a node pass
a streaming digest in order, in pieces made by ranges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.llm.common import cut, discard, n_words, running

#: A conversation takes its first turns from the one whose id is the multiple of FAMILY below it; HEADS - 1 at most.
FAMILY, HEADS = 20, 4
#: Characters of a piece of ids.
PIECE = 1 << 16
NONE = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """conv (id), n (place from 1), dig, words, upto (words so far) of each turn; null turns first, equal ones by role and digest.

    Rows without a conv_id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    dig = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    flat = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("turn"), role.alias("role"), dig.alias("dig"), n_words(text).alias("words"))
    return running(flat, ["conv"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("dig")], "n", upto="words").drop("turn", "role")


def as_they_are(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns (conv, depth, dig, words, upto) and conversations (conv, len, total) of turns()."""
    return own.withColumnRenamed("n", "depth"), own.groupBy("conv").agg(F.max("n").alias("len"), F.max("upto").alias("total"))


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same, where conversation c starts with the first crc32(c) % HEADS turns of conversation c - c % FAMILY (all if it has
    fewer, none if it is absent) and goes on with its own turns after as many. % keeps the sign of c."""
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS
    own = own.withColumn("h", h)
    at = lambda k: F.coalesce(F.max(F.when(F.col("n") <= k, F.col("upto"))), F.lit(0))
    convs = own.groupBy("conv", "h").agg(F.max("n").alias("own_len"), F.max("upto").alias("own_total"), at(F.col("h")).alias("skipped")).withColumn("base", F.expr(f"conv - conv % {FAMILY}"))
    first = own.filter(f"conv % {FAMILY} = 0 and n < {HEADS}").select(F.col("conv").alias("b"), F.col("n").alias("b_n"), F.col("dig").alias("b_dig"), F.col("words").alias("b_words"), F.col("upto").alias("b_upto"))
    heads = first.groupBy("b").agg(F.max("b_n").alias("b_len"), *[F.coalesce(F.max(F.when(F.col("b_n") <= k, F.col("b_upto"))), F.lit(0)).alias(f"u{k}") for k in range(HEADS)])
    known = convs.join(heads, F.col("base") == F.col("b"), "left").withColumn("k", F.least(F.col("h"), F.coalesce("b_len", F.lit(0))))
    before = F.coalesce(F.get(F.array(*[F.col(f"u{k}") for k in range(HEADS)]), F.col("k").cast("int")), F.lit(0))
    known = cut(
        known.select(
            "conv", "h", "base", "k", "skipped", before.alias("before"),
            (F.col("k") + F.greatest(F.col("own_len") - F.col("h"), F.lit(0))).alias("len"), (before + F.col("own_total") - F.col("skipped")).alias("total"),
        ),
        "known",
    )
    mine = own.filter("n > h").select("conv", "n", "dig", "words", "upto").join(known.select("conv", "h", "k", "before", "skipped"), "conv")
    mine = mine.select("conv", F.expr("k + n - h").alias("depth"), "dig", "words", F.expr("before + upto - skipped").alias("upto"))
    theirs = known.filter("k > 0").join(first, F.expr("base = b and b_n <= k")).select("conv", F.col("b_n").alias("depth"), F.col("b_dig").alias("dig"), F.col("b_words").alias("words"), F.col("b_upto").alias("upto"))
    return mine.unionByName(theirs), known.select("conv", "len", "total")


def _same(prefix: str = "") -> Column:
    return F.expr(f"{prefix}a_min = {prefix}a_max and {prefix}b_min = {prefix}b_max")


def _group(df: DataFrame, *keys: str) -> DataFrame:
    """One row a group: child (its name), n, len and total of one of the members, open (whether they differ)."""
    ends = [f(c).alias(f"{c}_{n}") for c in "ab" for n, f in (("min", F.min), ("max", F.max))]
    more = [F.max("words").alias("words"), F.max("upto").alias("upto")] if keys else []
    return df.groupBy(*keys).agg(F.min("conv").alias("child"), F.count(F.lit(1)).alias("n"), F.max("len").alias("len"), F.max("total").alias("total"), *more, *ends).withColumn("open", ~_same()).drop(*[f"{c}_{n}" for c in "ab" for n in ("min", "max")])


def ends_digests(ends: DataFrame) -> DataFrame:
    """node, depth and ends_sha256 of ends (node, depth, conv): the digest of each node's ids in order, comma-joined.

    Ranges of the ids of all nodes become pieces of text; those of a node then pass one digest, piece by piece.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first, held, size, rows = None, None, [], 0, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["node", "depth", "first", "piece"])

        for b in batches:
            for node, depth, conv in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if held and ((node, depth) != last or size > PIECE):
                    rows.append((*last, first, ",".join(held)))
                    held, size = [], 0
                if not held:
                    last, first = (node, depth), conv
                held.append(str(conv))
                size += len(held[-1]) + 1
                if sum(len(r[3]) for r in rows[-64:]) > 16 * PIECE or len(rows) >= 10_000:
                    yield out()
                    rows = []
        if held:
            rows.append((*last, first, ",".join(held)))
        if rows:
            yield out()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, h, rows = None, None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["node", "depth", "ends_sha256"])

        for b in batches:
            for node, depth, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                if (node, depth) == last:
                    h.update(b",")
                else:
                    if h:
                        rows.append((*last, h.hexdigest()))
                    last, h = (node, depth), hashlib.sha256()
                h.update(piece.encode())
            if len(rows) >= 10_000:
                yield out()
                rows = []
        if h:
            rows.append((*last, h.hexdigest()))
        if rows:
            yield out()

    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = ends.select("node", F.col("depth").cast("long").alias("depth"), "conv").repartitionByRange(parts, "node", "depth", "conv").sortWithinPartitions("node", "depth", "conv")
    cuts = ranged.mapInArrow(pieces, "node long, depth long, first long, piece string")
    return cuts.repartition("node", "depth").sortWithinPartitions("node", "depth", "first").mapInArrow(digests, "node long, depth long, ends_sha256 string")


def trie(flat: DataFrame, convs: DataFrame) -> DataFrame:
    """One row a node of conversations (conv, len, total) with their turns (conv, depth, dig, words, upto): conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. Without conversations there is no root.
    """
    spark = flat.sparkSession
    flat = cut(flat.repartitionByRange("depth", "conv").sortWithinPartitions("depth", "conv"), "turns")  # a level is a range of it
    whole = flat.groupBy("conv").agg(F.bit_xor(F.xxhash64("depth", "dig")).alias("a"), F.bit_xor(F.xxhash64("dig", "depth", F.lit(1))).alias("b"))
    live = cut(convs.join(whole, "conv", "left").select("conv", "len", "total", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b")), "live")
    root = _group(live).select(F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"), "child", "n", "len", "total", F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("upto"), "open")
    levels = [cut(root.filter("n > 0"), "level0")]
    first = levels[0].head()
    if first is None:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    live = live.withColumn("node", F.lit(first["child"]))
    closed = [live.select("node", F.col("len").alias("depth"), "conv").filter(F.lit(not first["open"]))]
    over, d = not first["open"], 0
    while not over:
        closed.append(live.filter(F.col("len") == d).select("node", F.lit(d).cast("long").alias("depth"), "conv"))
        d += 1
        turn = flat.filter(F.col("depth") == d).select("conv", "dig", "words", "upto")
        here = live.filter(F.col("len") >= d).join(turn, "conv")
        groups = cut(_group(here, "node", "dig").withColumn("depth", F.lit(d).cast("long")), f"level{d}")
        named = groups.select("node", "dig", "child", "open", F.col("n").alias("many"))
        told = cut(here.join(named, ["node", "dig"]).select("conv", "len", "total", "a", "b", F.col("child").alias("node"), "open", "many"), f"members{d}")
        closed.append(told.filter("not open and many > 1").select("node", F.col("len").alias("depth"), "conv"))
        live = told.filter("open").drop("open", "many")
        levels.append(groups.withColumnRenamed("node", "parent"))
        over = groups.filter("open").limit(1).count() == 0

    columns = ["depth", "parent", "child", "n", "len", "total", "words", "upto"]
    tops = [x.filter("not open").select(*columns) for x in levels]
    saved = F.expr("(n - 1) * (total - upto + words)")
    # what is below closed nodes: a chain each
    top = reduce(DataFrame.unionByName, tops).select("child", F.col("depth").alias("top"), "n", "len", "total")
    below = flat.join(top, F.expr("conv = child and depth > top")).select("depth", F.col("conv").alias("parent"), "child", "n", "len", "total", "words", "upto")
    chains = reduce(DataFrame.unionByName, [*tops, below]).select("child", "depth", "parent", "n", "len", F.expr("if(len > depth, 1L, 0L)").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), saved.alias("saved"))
    # open nodes, from the deepest level up
    rolled, kids = [], None
    for number, level in list(enumerate(levels))[::-1]:
        shut = tops[number].select("parent", F.lit(1).cast("long").alias("leaves"), saved.alias("saved"))
        mine = level.filter("open").select("depth", "parent", "child", "n", "words", F.lit(None).cast("long").alias("len"))
        if kids is not None:
            sums = kids.groupBy(F.col("parent").alias("own")).agg(F.count(F.lit(1)).alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("kept"))
            mine = cut(mine.join(sums, F.col("child") == F.col("own")).select("child", "depth", "parent", "n", "len", "n_children", "n_leaves", F.expr("(n - 1) * words + kept").alias("saved")), f"rolled{number}")
            rolled.append(mine)
            shut = shut.unionByName(mine.select("parent", F.col("n_leaves").alias("leaves"), "saved"))
        kids = shut
    ends = cut(ends_digests(reduce(DataFrame.unionByName, closed)), "ends").select(F.col("node").alias("e_node"), F.col("depth").alias("e_depth"), "ends_sha256")
    alone, none = F.sha2(F.col("child").cast("string").cast("binary"), 256), F.lit(NONE)
    shared = [chains.filter("n > 1 and len = depth"), *rolled]
    shared = reduce(DataFrame.unionByName, shared).join(ends, F.expr("child = e_node and depth = e_depth"), "left").drop("e_node", "e_depth").withColumn("ends_sha256", F.coalesce("ends_sha256", none))
    plain = chains.filter("n = 1 or len <> depth").withColumn("ends_sha256", F.when(F.col("len") == F.col("depth"), alone).otherwise(none))
    return plain.unionByName(shared).select(F.col("child").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they are (columns conv_id, turn, role, text); null roles and texts are empty."""
    return trie(*as_they_are(turns(conversations)))


def report(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations.

    Null roles and texts count as empty, rows without a conv_id are left out, equal rows are turns of their own (see turns()).
    Conversations may be rebuilt without a turn: they end at the root. An empty table gives no rows. Other columns are not read.
    """
    own = cut(turns(conversations.select("conv_id", "turn", "role", "text")), "numbered")
    return trie(*rebuilt(own))


ORACLE_SQL = rf"""
WITH own AS (SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
bits AS (SELECT c, ts, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(c::VARCHAR, ''), lambda ch: ascii(ch)::UBIGINT)), lambda a, x: list_reduce(list_prepend(xor(a, x), [1, 2, 3, 4, 5, 6, 7, 8]::UBIGINT[]), lambda y, i: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384::UBIGINT) ELSE y // 2 END)) AS crc FROM own),
heads AS (SELECT c, ts, (xor(crc, 4294967295::UBIGINT) % 4)::INTEGER AS h FROM bits),
built AS (SELECT a.c, list_concat(coalesce(b.ts, [])[1:a.h], a.ts[a.h + 1:]) AS ts FROM heads a LEFT JOIN own b ON b.c = a.c - a.c % 20),
flat AS (SELECT c, len(ts) AS n, d, md5(ts[1:d]::VARCHAR) AS k, CASE WHEN d > 0 THEN md5(ts[1:d - 1]::VARCHAR) END AS pk, CASE WHEN d > 0 THEN len(regexp_extract_all(ts[d].t, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words FROM built, unnest(range(0, len(ts) + 1)) u(d)),
nodes AS (SELECT d, k, any_value(pk) AS pk, min(c) AS id, count(*) AS n, any_value(words) AS words, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '') AS ends FROM flat GROUP BY d, k),
kids AS (SELECT d - 1 AS d, pk AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
spans AS (SELECT DISTINCT f.d, f.k, g.d AS bd, g.k AS bk FROM flat f JOIN flat g ON f.c = g.c AND g.d >= f.d),
below AS (SELECT s.d, s.k, sum((x.n - 1) * x.words)::BIGINT AS saved, count(*) FILTER (y.n IS NULL) AS leaves FROM spans s JOIN nodes x ON x.d = s.bd AND x.k = s.bk LEFT JOIN kids y ON y.d = s.bd AND y.k = s.bk GROUP BY ALL)
SELECT a.id AS conv_id, a.d::BIGINT AS depth, p.id AS parent_conv_id, a.n AS n_convs, coalesce(q.n, 0)::BIGINT AS n_children, b.leaves AS n_leaves, b.saved AS saved_tokens, sha256(a.ends) AS ends_sha256
FROM nodes a JOIN below b USING (d, k) LEFT JOIN nodes p ON p.d = a.d - 1 AND p.k = a.pk LEFT JOIN kids q ON q.d = a.d AND q.k = a.k
"""
