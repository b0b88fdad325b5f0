r"""Secret scans with DataFrame functions only: fixed patterns, and two character Markov models.

Spans are found without a UDF: split() gives what lies between the matches of a pattern, regexp_extract_all()
the matches, and running sums of their lengths the offsets. The models are first-order Markov chains over
characters, one trained on random strings and one on ordinary identifiers; a candidate is a secret if its mean
log-likelihood ratio a character pair exceeds a limit set on the labelled sample. Candidates are looked for in the text with base spans
masked, so that no two lists of spans are compared.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanmill.functions.text import bound, prefix_sums
from spanmill.llm.common import cut, drop_clashing

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Maximal runs, so the leftmost non-overlapping matches of the unbounded patterns that are long enough.
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
#: Stands for a character of a base span when candidates are looked for; Unicode has no character of this number.
MASK = "\ufdd0"
#: What the models judge: whole runs of LEAST or more such characters, a letter among them, that touch no base span.
LEAST = 16
CANDIDATE = rf"(?<![A-Za-z0-9+/_={MASK}-])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{{{LEAST},}}+(?!{MASK})"
IDENTIFIER = r"[A-Za-z][A-Za-z0-9_-]{5,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIZE = len(ALPHABET) + 1  # 0 is any other character
KINDS = ("assign", "access", "hex", "markov")
#: Bounds of the fit: documents whose identifiers are taken, random strings made.
FIT_DOCS, FIT_RANDOM = 1000, 4000
#: Share of the ordinary identifiers that the limit lets pass.
SPARE = 0.999
NONE = "array<struct<start:int,kind:int,stop:int>>"


def spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """array<struct<start,kind,stop>> of the matches whose group has at least `least` characters."""

    def placed(hits: Column) -> Column:
        sizes = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), hits, lambda g, h: (F.length(g) + F.length(h)).cast("long"))
        found = F.zip_with(prefix_sums(sizes), hits, lambda z, h: F.struct((z.cast("int") - F.length(h)).alias("start"), F.lit(kind).alias("kind"), z.cast("int").alias("stop")))
        if not least:
            return found
        both = F.zip_with(found, F.regexp_extract_all(text, F.lit(pattern), group), lambda s, g: F.struct(s.alias("s"), F.length(g).alias("n")))
        return F.transform(F.filter(both, lambda x: x["n"] >= least), lambda x: x["s"])

    return F.when(F.rlike(text, F.lit(pattern)), bound(F.regexp_extract_all(text, F.lit(pattern), 0), placed)).otherwise(F.array().cast(NONE))


def masked(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """text with MASK for each character of the pattern's matches whose group has at least `least` characters."""
    gaps = F.split(text, pattern, -1)
    own = F.regexp_extract_all(text, F.lit(pattern), 0)
    hits = F.zip_with(own, F.regexp_extract_all(text, F.lit(pattern), group), lambda h, g: F.when(F.length(g) >= least, F.repeat(F.lit(MASK), F.length(h))).otherwise(h))
    return F.when(F.rlike(text, F.lit(pattern)), F.array_join(F.zip_with(gaps, hits, lambda g, h: F.concat(g, F.coalesce(h, F.lit("")))), "")).otherwise(text)


def pairs(text: Column) -> Column:
    """Numbers of the neighbouring characters of text."""
    code = lambda i: F.instr(F.lit(ALPHABET), F.substring(text, i, F.lit(1)))
    return F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: code(i) * SIZE + code(i + 1))


def random_strings(spark: SparkSession, n: int = FIT_RANDOM) -> DataFrame:
    """Labelled random strings: hexadecimal, base64, and letters with digits, from digests of 0 to n - 1."""
    i = F.col("id").cast("string")
    b64 = F.base64(F.unhex(F.sha2(F.concat(F.lit("b"), i).cast("binary"), 256)))
    kinds = F.array(F.substring(F.sha2(F.concat(F.lit("h"), i).cast("binary"), 256), 1, 40), F.substring(b64, 1, 40), F.upper(F.regexp_replace(b64, "[^A-Za-z0-9]", "")))
    return spark.range(n).select(F.explode(kinds).alias("text"), F.lit(1).alias("label"))


def ordinary(docs: DataFrame, text: str = "text", key: str = "doc_id", n: int = FIT_DOCS) -> DataFrame:
    """Labelled identifiers: those of the n documents of smallest hash (of id and text; of equal ones one) in which no fixed pattern is
    met, and the same ones joined by twos and threes, as long names are."""
    h = F.xxhash64(F.col(f"`{key}`").cast("string"), F.col(f"`{text}`"))
    chosen = docs.select(h.alias("h")).distinct().orderBy("h").limit(n)
    few = docs.select(h.alias("h"), F.col(f"`{text}`").alias("t")).join(F.broadcast(chosen), "h", "left_semi").dropDuplicates(["h"])  # n numbers, n texts at most
    met = [F.rlike("t", F.lit(p)) for p in (ASSIGN, ACCESS, HEX)]
    clean = few.filter(F.col("t").isNotNull() & ~met[0] & ~met[1] & ~met[2])
    names = cut(clean.select(F.explode(F.regexp_extract_all("t", F.lit(IDENTIFIER), 0)).alias("text")).distinct(), "names")
    order = Window.partitionBy(F.pmod(F.xxhash64("text"), F.lit(64))).orderBy(F.md5("text"))
    next_, third = F.lead("text", 1).over(order), F.lead("text", 2).over(order)
    joined = names.withColumn("all", F.array("text", F.upper("text"), F.upper(F.concat("text", F.coalesce(next_, F.lit("")))), F.concat_ws("_", "text", next_), F.concat(F.initcap("text"), F.coalesce(F.initcap(next_), F.lit(""))), F.concat_ws("_", "text", next_, third)))
    return joined.select(F.explode("all").alias("text")).distinct().select("text", F.lit(0).alias("label"))


def train(samples: DataFrame) -> tuple[list, float]:
    """(log-likelihood ratios by pair, limit) from rows (text, label): 1 for random strings, 0 for ordinary ones.

    The pair counts are SIZE^2 numbers a label at most, added by one each. Without random or without ordinary
    samples the limit is infinite: nothing is reported.
    """
    long = samples.filter(F.length("text") >= 2)
    counts = {(r[0], r[1]): r[2] for r in long.select("label", F.explode(pairs(F.col("text"))).alias("p")).groupBy("label", "p").count().collect()}
    log: dict = {}
    for label in (0, 1):
        for a in range(SIZE):
            row = [counts.get((label, a * SIZE + b), 0) + 1 for b in range(SIZE)]
            whole = sum(row)
            for b in range(SIZE):
                log[label, a * SIZE + b] = math.log(row[b] / whole)
    ratio = [round(log[1, p] - log[0, p], 9) for p in range(SIZE * SIZE)]
    if len({label for label, _ in counts}) < 2:
        return ratio, math.inf
    limit = long.filter("label = 0").agg(F.percentile(score(F.col("text"), ratio), F.lit(SPARE))).head()[0]
    return ratio, max(0.0, limit)


def score(text: Column, ratio: list) -> Column:
    """Mean log-likelihood ratio of the character pairs of text."""
    table = F.from_json(F.lit(json.dumps(ratio)), "array<double>")
    total = F.aggregate(pairs(text), F.lit(0.0), lambda s, p: s + F.get(table, p))
    return total / F.greatest(F.length(text) - 1, F.lit(1))


def scan(docs: DataFrame, model: tuple[list, float], text: str = "text") -> DataFrame:
    """docs with `base` and `added`: arrays of (start, kind, stop), code points from 0, stop exclusive, in order.

    kind is a place in KINDS. Null and empty texts have none; repeated rows have the same each; an empty table stays empty. Added spans do
    not overlap base ones. Columns named base or added give way.
    """
    ratio, limit = model
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base = F.array_sort(F.concat(spans(t, ASSIGN, 0, 2, 6), spans(t, ACCESS, 1), spans(t, HEX, 2)))
    docs = drop_clashing(docs, "base", "added").withColumn("base", base)
    if math.isinf(limit):
        return docs.withColumn("added", F.array().cast(NONE))
    free = masked(masked(masked(t, ASSIGN, 2, 6), ACCESS), HEX)

    def judged(hidden: Column) -> Column:
        hits = F.regexp_extract_all(hidden, F.lit(CANDIDATE), 0)
        both = F.zip_with(spans(hidden, CANDIDATE, 3), hits, lambda s, h: F.struct(s.alias("s"), score(h, ratio).alias("score")))
        return F.transform(F.filter(both, lambda x: x["score"] > limit), lambda x: x["s"])

    return docs.withColumn("added", bound(free, judged))


def written(c: Column) -> Column:
    """kind:start:stop, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of base spans, their digest, and all spans of every document, as scan() finds them."""
    docs = docs.select("doc_id", "text")
    model = train(cut(random_strings(docs.sparkSession).unionByName(ordinary(docs)), "samples"))
    found = scan(docs, model)
    many = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        many(0).alias("n_assign"),
        many(1).alias("n_access"),
        many(2).alias("n_hex"),
        F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        written(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )
