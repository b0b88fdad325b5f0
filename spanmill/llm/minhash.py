"""Near-duplicate documents by BagMinHash over five-word shingles.

A document is the multiset of its shingles. Every shingle carries a hierarchy of Poisson processes over
the discretised weight axis [0,1), [1,2), [2,4), [4,8), ...: a process of a range of width b has rate b,
its points fall into one of M signature places and onto one unit of the range, and a document of weight w
sees the points below w only. For each place the earliest point is kept, so two documents agree in a place
with the probability of their weighted Jaccard similarity. Points are drawn in order of time and only while
they can still be earlier than the latest place, so a signature costs little more than one point a shingle.

Signatures are banded. Documents of one text are one node; each node of a bucket is verified against a pivot of
the bucket, connected components are built, some turns with other pivots follow, and nodes of buckets that still hold different components are then verified with each
other, as far as they share one of their rarest shingles - which nodes of the least similarity always do. So no
link between different components of a bucket is missed, nodes that are joined already are never paired, and
neither are those that merely share a common passage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.llm.common import TABLES, Marks, cut, discard, summed, trimmed, unused

#: Words of a shingle; least similarity; bands and places of a band (a pair of similarity 0.8 is missed with 7e-5).
WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 24, 5
M = BANDS * ROWS
#: Earlier shingles of a prefix that a posting remembers.
NEAREST = 8
#: Turns of pivots before what is left of a bucket is paired.
PIVOTS = 2
#: Words whose hashes a worker keeps; size of the table of shingle counts, as a power of two.
MAX_WORDS, SKETCH_BITS = 100_000, 20
#: Longs of the bits by which pairs are told apart before their multisets are compared.
PARITY = 8
U = np.uint64
GAMMA, MIX1, MIX2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 (public domain)."""
    x = (x ^ (x >> U(30))) * MIX1
    x = (x ^ (x >> U(27))) * MIX2
    return x ^ (x >> U(31))


class Hashes(dict):
    """Word -> 64-bit hash, the same on every machine."""

    def __missing__(self, word: str) -> int:
        h = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "little")
        return h


HASHES = Hashes()
TABLES.append(HASHES)


def shingles(text: str | None, k: int = WORDS) -> np.ndarray:
    """Hashes of the k-word windows of the lower-cased text, with repeats; a shorter text is one shingle."""
    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, U)
    if len(HASHES) > MAX_WORDS:
        HASHES.clear()
    h = np.array([HASHES[w] for w in words], U)
    n = max(1, len(h) - k + 1)
    out = np.full(n, U(len(words) if len(words) < k else k))
    for j in range(min(k, len(h))):
        out = mix(out * GAMMA + h[j : j + n])
    return out


def signature(bag: np.ndarray, m: int = M) -> np.ndarray:
    """BagMinHash: the identities of the earliest points, one for each of m places."""
    items, counts = np.unique(bag, return_counts=True)
    seeds, widths, covers = [mix(items)], [np.ones(len(items))], [np.ones(len(items), np.int64)]
    start, level = 1, 1
    while (more := counts > start).any():
        seeds.append(mix(items[more] + np.array([level], U) * GAMMA))
        widths.append(np.full(more.sum(), float(start)))
        covers.append(np.minimum(counts[more] - start, start))
        start, level = start * 2, level + 1
    seed, width, cover = map(np.concatenate, (seeds, widths, covers))
    best, who = np.full(m, np.inf), np.zeros(m, U)
    time, k = np.zeros(len(seed)), 0
    while len(seed):
        many = max(1, ceil(2 * m / len(seed)))
        ks = np.arange(k + 1, k + many + 1, dtype=U)
        r = mix(seed[:, None] + GAMMA * ks[None])
        t = time[:, None] + np.cumsum(-np.log1p(-((r >> U(11)).astype(float) * 2.0**-53)) / width[:, None], axis=1)
        where = mix(r ^ MIX1)
        place = ((where >> U(32)) % U(m)).astype(np.int64)
        unit = np.floor((where & U(0xFFFFFFFF)).astype(float) * 2.0**-32 * width[:, None])
        good = (unit < cover[:, None]) & (t < best[place])
        gt, gp, gr = t[good], place[good], r[good]
        order = np.argsort(-gt, kind="stable")  # of several points in one place the earliest is written last
        best[gp[order]], who[gp[order]] = gt[order], gr[order]
        time, k = t[:, -1], k + many
        left = time < best.max()
        seed, width, cover, time = seed[left], width[left], cover[left], time[left]
    return who


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    parts = sig.reshape(-1, rows)
    out = np.arange(1, len(parts) + 1, dtype=U)
    for j in range(rows):
        out = mix(out * GAMMA + parts[:, j])
    return out.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two multisets, both sorted."""
    x, n = np.unique(a, return_counts=True)
    y, k = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], k[j]).sum())
    return both / max(1, len(a) + len(b) - both)


def signed(docs: DataFrame, text: str, others: list[str], k: int) -> DataFrame:
    """`others`, node (digest of the text) and the band keys of each document; none without words."""
    rows = docs.select(*others, F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("node"), F.col(text).alias("__text"))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]], "bands array<long>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b, last, keys = whole.slice(at, 1000), {}, []
                for node, t in zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                    if node not in last:
                        bag = shingles(t, k)
                        last[node] = bands(signature(bag)) if len(bag) else []
                    keys.append(last[node])
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(keys, pa.list_(pa.int64()))], names=[*b.schema.names[:-1], "bands"])

    return rows.mapInArrow(trimmed(run), schema)


def occurrences(bag: np.ndarray) -> np.ndarray:
    """A sorted multiset as a set: the k-th copy of an item becomes an item of its own."""
    if not len(bag):
        return bag
    fresh = np.concatenate([[True], bag[1:] != bag[:-1]])
    starts = np.flatnonzero(fresh)
    return mix(bag + GAMMA * (np.arange(len(bag)) - np.repeat(starts, np.diff(np.append(starts, len(bag))))).astype(U))


def parity(bag: np.ndarray) -> np.ndarray:
    """PARITY longs: a bit is set where an odd number of the multiset's occurrences fall. Bits that differ between
    two of these are never more than the occurrences that only one of the multisets has."""
    places = (occurrences(bag) & U(64 * PARITY - 1)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=64 * PARITY) & 1).astype(np.uint8)).view(np.int64)


def close(least: float) -> Column:
    """Whether n_a, bits_a, n_b and bits_b leave it open that two multisets are similar enough; true for all that are."""
    differ = " + ".join(f"bit_count(bits_a[{i}] ^ bits_b[{i}])" for i in range(PARITY))
    return F.expr(f"{differ} <= (n_a + n_b) * {(1 - least) / (1 + least)} + 1e-6")


def verified(pairs: DataFrame, bags: DataFrame, least: float) -> DataFrame:
    """Those rows of pairs (a, b, la, lb: labels) whose multisets are similar enough; their labels, once each.

    Pairs meet the bits of their multisets first; only those that these leave open carry multisets along.
    """
    side = lambda x, *more: bags.select(*[F.col(c).alias(x if c == "node" else f"{c}_{x}") for c in ("node", "n", "bits", *more)])
    left = pairs.join(side("a"), "a").join(side("b", "bag"), "b").filter(close(least)).select("a", "la", "lb", "bag_b")
    both = left.join(bags.select(F.col("node").alias("a"), F.col("bag").alias("bag_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [similarity(np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)) >= least for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.select(F.col("la").alias("a"), F.col("lb").alias("b"), "bag_a", "bag_b").mapInArrow(trimmed(run), "a string, b string").distinct()


def _bag_places(bags: pa.Array) -> np.ndarray:
    parts = [occurrences(np.frombuffer(b.as_buffer(), U)) for b in bags]
    return (np.concatenate(parts) & U((1 << SKETCH_BITS) - 1)).astype(np.int64) if parts else np.zeros(0, np.int64)


def rare_pairs(own: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of nodes of different labels that may be similar: those that share one of their rarest
    shingles, under the prefix, length and positional filters of an exact similarity join. A pair of the least
    similarity is never lost; texts that only have a common passage in common rarely meet."""
    counts = own.sparkSession.sparkContext.broadcast(summed(own, "bag", SKETCH_BITS, _bag_places))  # 2^SKETCH_BITS numbers

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
            out: list = [[], [], [], [], [], []]
            for node, label, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                items = occurrences(np.frombuffer(raw.as_buffer(), U))
                c = counts.value[(items & U((1 << SKETCH_BITS) - 1)).astype(np.int64)]
                order = np.lexsort((items, c))
                n, before = len(items), []
                for i, at in enumerate(order[: n - ceil(least * n - 1e-9) + 1].tolist()):
                    if c[at] > 1:
                        item = int(items[at]) - (1 << 63)
                        for column, value in zip(out, (item, node, label, n, i, before[-NEAREST:]), strict=True):
                            column.append(value)
                        before.append(item)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["item", "node", "label", "n", "i", "before"])

    posting = cut(own.select("node", "label", "bag").mapInArrow(trimmed(prefixes), "item long, node string, label string, n int, i int, before array<long>"), "prefixes")
    mixed = posting.groupBy("item").agg(F.min("label").alias("l1"), F.max("label").alias("l2")).filter("l1 <> l2").select("item")
    posting = posting.join(mixed, "item", "left_semi")
    fits = (
        f"least(x.n, y.n) >= {least} * greatest(x.n, y.n) - 1e-9"
        f" and least(x.n - x.i, y.n - y.i) >= {least} / {1 + least} * (x.n + y.n) - 1e-9"
    )
    # a pair that has just met in an earlier item, which passed the filters too, need not meet again
    both = posting.alias("x").join(posting.alias("y"), F.expr(f"x.item = y.item and x.label < y.label and {fits} and not arrays_overlap(x.before, y.before)"))
    return both.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.label").alias("la"), F.col("y.label").alias("lb")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, label: the smallest node of its component, for all nodes of edges (a, b).

    Alternating large-star and small-star steps (Kiveris and others, 2014), as joins with minima, so
    that no list of neighbours meets in one task; each round is written out. It ends when every edge leads to
    a node from which none leads on.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    for _ in range(rounds):
        # once every node has one edge, down to a node that has none, all is done
        ways = now.groupBy("u").agg(F.count("*").alias("n"))
        if not now.select(F.col("v").alias("u"), F.lit(1).cast("long").alias("n")).join(ways.select("u"), "u", "left_semi").unionByName(ways.filter("n > 1")).limit(1).count():
            break
        near = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = near.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        last, now = now, cut(small.filter("u <> v").distinct(), "edges")
        discard(last)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label"))


def mixed_members(member: DataFrame, turn: int = 0) -> DataFrame:
    """Members (bucket, node, label) of buckets that hold different labels, with the bucket's pivot (b, lb).

    The pivot of turn 0 is the smallest node, so that groups of copies meet in few nodes; later ones differ by
    bucket, so that each node is compared with up to as many others as it has bands.
    """
    order = F.lit(0).cast("long") if turn == 0 else F.xxhash64("node", "bucket", F.lit(turn))
    held = member.groupBy("bucket").agg(F.min("label").alias("l1"), F.max("label").alias("l2"), F.min(F.struct(order.alias("o"), "node", "label")).alias("p"))
    return member.join(held.filter("l1 <> l2").select("bucket", F.col("p.node").alias("b"), F.col("p.label").alias("lb")), "bucket")


def pivot_pairs(member: DataFrame, turn: int) -> DataFrame:
    """Members of mixed buckets with their pivot, where the labels differ."""
    return mixed_members(member, turn).filter("label <> lb").select(F.col("node").alias("a"), "b", F.col("label").alias("la"), "lb").distinct()


def relabelled(member: DataFrame, links: DataFrame) -> DataFrame:
    """member with labels that links (a, b) join made one: the smallest of them."""
    one = components(links).select(F.col("node").alias("label"), F.col("label").alias("new"))
    out = cut(member.join(one, "label", "left").select("bucket", "node", F.coalesce("new", "label").alias("label")), "members")
    discard(member, links)
    return out


def classes(docs: DataFrame, text: str = "text", others: tuple = ("doc_id",), least: float = SIMILARITY, k: int = WORDS) -> DataFrame:
    """`others`, node and label of every row of docs; rows of one label are near-duplicates of each other.

    Equal texts share a label, which is the smallest digest of the class. Null, empty and blank texts have no
    shingles and the label null: each is alone. An empty table gives an empty result.
    """
    rows = cut(signed(docs, text, list(others), k), "signatures")
    nodes = rows.filter(F.size("bands") > 0).groupBy("node").agg(F.first("bands").alias("bands"))
    every = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = every.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    member = cut(every.join(shared, "bucket", "left_semi").withColumn("label", F.col("node")), "members")
    wanted = cut(member.select("node").distinct(), "wanted")
    few = Marks(wanted, "node")  # texts that have no partner stay where they are

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                own = [np.sort(shingles(t, k)) for t in b.column(1).to_pylist()]
                columns = [b.column(0), pa.array([x.tobytes() for x in own], pa.binary()), pa.array([len(x) for x in own], pa.int64()), pa.array([parity(x) for x in own], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "bag", "n", "bits"])

    texts = docs.select(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("node"), F.col(text).alias("t"))
    bags = cut(texts.filter(few.maybe(F.col("node"))).join(wanted, "node", "left_semi").dropDuplicates(["node"]).mapInArrow(trimmed(bag), "node string, bag binary, n long, bits array<long>"), "bags")
    for turn in range(PIVOTS):
        pairs = cut(pivot_pairs(member, turn), "pivots")
        member = relabelled(member, cut(verified(pairs, bags, least), "links"))
        discard(pairs)
    doubtful = mixed_members(member).select("node", "label").distinct()
    own = cut(bags.join(doubtful, "node").select("node", "label", "bag"), "doubtful")
    pairs = cut(rare_pairs(own, least), "cross")
    member = relabelled(member, cut(verified(pairs, bags, least), "links"))
    label = member.select("node", "label").distinct()
    alone = F.when(F.size("bands") > 0, F.coalesce("label", "node"))
    out = cut(rows.join(label, "node", "left").select(*others, "node", alone.alias("label")), "classes")
    discard(rows, member, bags, own, pairs, wanted)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class), class_size, of every document."""
    rows = classes(docs.select("doc_id", "text"))
    sizes = rows.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    out = rows.join(sizes, "label", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs without near-duplicates: of each class the row of smallest doc_id, of equal rows one.

    Only rows that may go are shuffled; a filter by marks lets the others pass where they are. Columns of any name stay.
    """
    node, key, list_, stays, alone = unused(docs, "__node", "__key", "__list", "__stays", "__alone")
    rows = classes(docs.select("doc_id", "text"))
    first = rows.filter("label is not null").groupBy("label").agg(F.min(F.struct("doc_id", "node")).alias("m")).select(F.col("label").alias("l"), "m")
    kinds = rows.filter("label is not null").groupBy("label", "doc_id", "node").agg(F.count(F.lit(1)).alias("n"))
    told = kinds.join(first, F.col("label") == F.col("l")).select("doc_id", "node", "n", F.struct("doc_id", "node").eqNullSafe(F.col("m")).alias("stays"))
    touched = cut(told.filter("n > 1 or not stays"), "touched")  # what goes, and rows that are there more than once
    marks = Marks(touched, "doc_id", "node")
    marked = docs.withColumn(node, F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    met = marks.maybe(F.col("doc_id"), F.col(node))
    known = touched.select(F.col("doc_id").alias(key), F.col("node").alias(list_), F.col("stays").alias(stays))
    both = marked.filter(met).join(known, (F.col(node) == F.col(list_)) & F.col("doc_id").eqNullSafe(F.col(key)), "left").filter(F.coalesce(F.col(stays), F.lit(True)))
    # met by chance: it is no repeated row
    left = both.withColumn(alone, F.when(F.col(stays).isNull(), F.monotonically_increasing_id())).dropDuplicates([node, key, alone])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return marked.filter(~met).select(*columns).unionByName(left.select(*columns))
