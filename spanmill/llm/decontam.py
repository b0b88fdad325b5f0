"""Benchmark decontamination over a distributed positional inverted index.

1. One pass tokenises every document and stores, for each document, its terms with the positions that
   can belong to a phrase match: the word and its neighbours have to follow each other in some
   benchmark item too, over at least the shortest window. A Bloom filter of the items' neighbours, sized by
   their number, tells; where it errs the index holds more. Turned round, that is the inverted index.
2. The lists of the RARE rarest terms of every benchmark window, by document frequency, are fetched;
   a list is shifted by the term's offset in the item, so places of one match meet in one diagonal
   (position in the document minus position in the item).
3. Diagonals that hold all rare terms of a window are compared with the whole item, position by
   position, on the stored postings of the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanmill.llm.common import cut, drop_clashing, summed, trimmed

#: Words of a window; rarest terms of a window whose lists are intersected first.
WINDOW, RARE = 13, 2
#: Bits of the filter for each word of the benchmark, and of the whole filter at most, as a power of two.
BLOOM_EACH, BLOOM_BITS = 16, 28
#: Bytes as words see them: A-Z become a-z, all that parts words becomes a blank.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(WORD_BYTES).split()


def _tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """key as string, its words and a row number; of benchmark items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            split = [[w.decode("utf-8", "replace") for w in words(t)] if t else [] for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(split, pa.list_(pa.string()))], names=["item", "item_id", "words"])

    rows = df.select(F.monotonically_increasing_id().alias("item"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item_id"), F.col(text).alias("t"))
    return rows.mapInArrow(run, "item long, item_id string, words array<string>").filter(F.size("words") > 0)


U = np.uint64


def _hashed(ws: list, least: int) -> np.ndarray:
    """Hashes of the pairs of neighbours among words, or of the words where a single one is a window."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, ws), U, len(ws))
    return h if least < 2 else (h[:-1] * U(0x9E3779B97F4A7C15) + h[1:]) * U(0xBF58476D1CE4E5B9) >> U(1)


class Neighbours:
    """Bloom filter of what follows what in the items' words."""

    def __init__(self, items: DataFrame, window: int):
        row = items.agg(F.sum(F.size("words")), F.min(F.size("words"))).head()
        self.least = min(window, row[1] or 1)
        self.bits = bits = min(BLOOM_BITS, max(10, (BLOOM_EACH * (row[0] or 0)).bit_length()))
        least = self.least

        def places(lists: pa.Array) -> np.ndarray:
            parts = [_hashed([w.encode() for w in ws], least) for ws in lists.to_pylist()]
            return (np.concatenate(parts) >> U(63 - bits) & U((1 << bits) - 1)).astype(np.int64) if parts else np.zeros(0, np.int64)

        self.table = summed(items, "words", bits, places, marks=True)

    def places(self, ws: list) -> list[int]:
        """Positions worth storing."""
        p = (_hashed(ws, self.least) >> U(63 - self.bits) & U((1 << self.bits) - 1)).astype(np.int64)
        met = (self.table[p >> 3] >> (7 - (p & 7)).astype(np.uint8) & 1).astype(np.int8)
        if self.least < 2:
            return np.flatnonzero(met).tolist()
        edges = np.flatnonzero(np.diff(np.concatenate([[0], met, [0]])))
        out: list[int] = []
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a + 1 >= self.least:
                out.extend(range(a, b + 1))
        return out


def store(docs: DataFrame, known: Neighbours | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """row (long), key, n_words and postings (array of term, positions) of every document."""
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(known)  # at most 2^BLOOM_BITS bits
    posting = pa.list_(pa.struct([("term", pa.string()), ("positions", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b, sizes, lists = whole.slice(at, 1000), [], []
                for t in b.column(2).to_pylist():
                    ws = words(t) if t else []
                    sizes.append(len(ws))
                    by: dict = {}
                    for i in (range(len(ws)) if shared.value is None else shared.value.places(ws)) if ws else ():
                        by.setdefault(ws[i], []).append(i)
                    lists.append([{"term": w.decode("utf-8", "replace"), "positions": p} for w, p in by.items()])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(lists, posting)], names=["row", "key", "n_words", "postings"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("t"))
    return rows.mapInArrow(trimmed(run), f"row long, key {kind}, n_words long, postings array<struct<term:string,positions:array<int>>>")


def index(stored: DataFrame) -> DataFrame:
    """The inverted index: term, row, positions."""
    return stored.select("row", F.explode("postings").alias("p")).select("p.term", "row", "p.positions")


def plan(items: DataFrame, frequency: DataFrame, window: int = WINDOW, rare: int = RARE) -> DataFrame:
    """item, words, anchors (positions in the item to look up) and, for each window, the anchors it needs."""
    n = F.size("words")
    wins = items.select("item", "words", F.explode(F.sequence(F.lit(0), F.greatest(n - window, F.lit(0)))).alias("start"))
    terms = wins.select("item", "start", F.posexplode(F.slice("words", F.col("start") + 1, F.lit(window))).alias("off", "term"))
    seen = terms.join(frequency, "term", "left").fillna(0, ["df"])
    first = F.array_sort(F.collect_list(F.struct("df", (F.col("start") + F.col("off")).alias("at"), "term")))
    best = seen.groupBy("item", "start").agg(first.alias("all"))
    possible = best.filter(F.col("all")[0]["df"] > 0)  # a window with an unseen term has no match
    return possible.select("item", "start", F.slice("all", 1, rare).alias("rare"))


def matches(stored: DataFrame, items: DataFrame, window: int = WINDOW, rare: int = RARE) -> DataFrame:
    """row, item, and the ranges [from, to) of the document's words inside exact window matches."""
    inverted = index(stored)
    frequency = inverted.groupBy("term").agg(F.count("*").alias("df"))
    wins = cut(plan(items, frequency, window, rare), "windows")
    anchors = wins.select("item", F.explode("rare").alias("a")).select("item", F.col("a.term").alias("term"), F.col("a.at").alias("at")).distinct()
    met = inverted.join(anchors, "term").select("row", "item", "at", F.explode("positions").alias("p"))
    diagonals = met.groupBy("row", "item", (F.col("p") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("ats"))
    needs = wins.groupBy("item").agg(F.collect_set(F.transform("rare", lambda r: r["at"])).alias("needs"))
    full = F.exists("needs", lambda need: F.forall(need, lambda a: F.array_contains("ats", a)))
    found = diagonals.join(needs, "item").filter(full).select("row", "item", "diagonal")
    own = found.groupBy("row", "item").agg(F.collect_list("diagonal").alias("diagonals")).join(items.select("item", "words"), "item")
    # a document's postings meet all its diagonals at once
    by_row = own.groupBy("row").agg(F.collect_list(F.struct("item", "words", "diagonals")).alias("tries"))
    both = by_row.join(stored.select("row", "postings"), "row")
    ranges = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(whole.num_rows):
                row, tries, postings = (c[0].as_py() for c in whole.slice(at, 1).columns)
                place = Places(postings)
                found = [(t["item"], place.ranges(t["words"], np.array(sorted(t["diagonals"]), np.int64), window)) for t in tries]
                found = [(i, r) for i, r in found if r]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(found), pa.int64()), pa.array([i for i, _ in found], pa.int64()), pa.array([r for _, r in found], ranges)], names=["row", "item", "ranges"])

    return both.select("row", "tries", "postings").mapInArrow(trimmed(verify), "row long, item long, ranges array<struct<start:int,stop:int>>")


#: Words compared at a time.
COMPARED = 1 << 20


class Places:
    """What stands where in a document, by its postings (term, positions)."""

    def __init__(self, postings: list):
        self.codes = {p["term"]: k for k, p in enumerate(postings)}
        sizes = [len(p["positions"]) for p in postings]
        at = np.fromiter((x for p in postings for x in p["positions"]), np.int64, sum(sizes))
        by = np.argsort(at, kind="stable")
        self.at, self.code = at[by], np.repeat(np.arange(len(postings)), sizes)[by]

    def ranges(self, words: list, diagonals: np.ndarray, window: int) -> list[dict]:
        """Ranges [start, stop) of at least a window of the item's words that stand in the document, on these diagonals."""
        n = len(words)
        wanted, least, out = np.array([self.codes.get(w, -1) for w in words], np.int64), min(window, n), []
        step = max(1, COMPARED // n)
        for k in range(0, len(diagonals), step):
            some = diagonals[k : k + step]
            place = some[:, None] + np.arange(n)
            found = np.minimum(np.searchsorted(self.at, place), len(self.at) - 1)
            same = (self.at[found] == place) & (self.code[found] == wanted)
            edges = np.diff(np.pad(same.astype(np.int8), ((0, 0), (1, 1))), axis=1)
            (line, first), (_, last) = np.nonzero(edges == 1), np.nonzero(edges == -1)
            long = last - first >= least
            out += [{"start": a, "stop": z} for a, z in zip((some[line] + first)[long].tolist(), (some[line] + last)[long].tolist(), strict=True)]
        return out


def proximity(docs: DataFrame, items: DataFrame, slop: int, key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """key, item_id: documents in which the two rarest distinct terms of an item stand at most slop words apart."""
    bench = cut(_tokens(items, item_key, text), "items")
    vocabulary = bench.select(F.explode("words").alias("term")).distinct()
    inverted = cut(index(store(docs, None, key, text)).join(vocabulary, "term", "left_semi"), "postings")
    frequency = inverted.groupBy("term").agg(F.count("*").alias("df"))
    terms = bench.select("item", "item_id", F.explode(F.array_distinct("words")).alias("term")).join(frequency, "term", "left").fillna(0, ["df"])
    rare = terms.groupBy("item", "item_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("df", "term"))), 1, 2).alias("r"))
    rare = rare.filter((F.size("r") == 2) & (F.col("r")[0]["df"] > 0)).select("item_id", F.col("r")[0]["term"].alias("a"), F.col("r")[1]["term"].alias("b"))
    one = rare.join(inverted.withColumnRenamed("term", "a").withColumnRenamed("positions", "pa"), "a")
    two = one.join(inverted.withColumnRenamed("term", "b").withColumnRenamed("positions", "pb"), ["b", "row"])
    near = F.exists("pa", lambda p: F.exists("pb", lambda q: F.abs(p - q) <= slop))
    return two.filter(near).select("row", "item_id").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, rare: int = RARE, key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """row, key, n_words, n_hit, items (sorted ids as strings) of every document.

    Null texts have no words. Repeated documents are judged each by itself; repeated items, and items with one id,
    count once. A null item id counts as the empty text. Empty tables give no matches.
    """
    items = cut(_tokens(benchmark, item_key, text), "items")
    stored = cut(store(docs, Neighbours(items, window), key, text), "postings")
    hits = matches(stored, items, window, rare).join(items.select("item", "item_id"), "item")
    by_row = hits.groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("ranges"))).alias("ranges"), F.array_sort(F.collect_set("item_id")).alias("items"))
    total = F.aggregate(
        "ranges",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda s, r: F.struct((s["n"] + F.greatest(F.lit(0), r["stop"] - F.greatest(r["start"], s["end"]))).cast("long").alias("n"), F.greatest(s["end"], r["stop"]).alias("end")),
        lambda s: s["n"],
    )
    none = F.array().cast("array<string>")
    out = stored.select("row", "key", "n_words").join(by_row.select("row", total.alias("n_hit"), "items"), "row", "left")
    return out.select("row", F.col("key").alias(key), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"))


def contaminated() -> F.Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    out = decontaminate(docs.select("doc_id", "text"), benchmark.select("item_id", "text"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bs AS (SELECT item_id, w, least(len(w), 13) AS k, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, s, s + k - 1), ' ') AS win FROM bs),
ks AS (SELECT DISTINCT k FROM bw),
ds AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, ks WHERE len(w) >= k),
dw AS (SELECT doc_id, k, s, array_to_string(list_slice(w, s, s + k - 1), ' ') AS win FROM ds),
h AS (SELECT dw.doc_id, dw.s, dw.k, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS pos FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(p.n_hit, 0)::BIGINT AS n_hit, coalesce(i.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AND 20 * coalesce(p.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN i USING (doc_id)
"""
