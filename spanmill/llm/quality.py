"""Quality rules and an isolation forest on their statistics.

statistics() reads each whole text once; the rest works on the few numbers it leaves, which are
written out, so texts are read a single time. Each tree of the forest has a subsample of its own of all documents,
as the method has it; ranks are counted over all documents, and the threshold over all labelled ones. Every document is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanmill.llm.common import cut, drop_clashing

TREES, SUBSAMPLE, SEED = 100, 256, 7
#: Share of the labelled good documents that the calibrated threshold has to keep: with labelled bad ones, and without.
KEEP_GOOD, KEEP_GOOD_ALONE = 0.98, 0.995
#: Anomalies are told apart in steps of 1 / CELLS, so that their counts over all labelled rows fit the driver.
CELLS = 1 << 16
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
RANKED = ("n_words", "n_lines")
FAILED = "(n_words < 10 or 100 * n_repeat_words > 20 * n_words)"
SYMBOLS, SPACES, WINDOW = b"#*$%&|<>", b" \t\n\v\f\r", 5


def repeat_words(words: list, k: int = WINDOW) -> int:
    """Words inside k-word windows that occur twice or more in words."""
    n = len(words) - k + 1
    if n < 2:
        return 0
    seen: dict = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    if len(seen) == len(words):
        return 0
    code, base = ids, len(seen)
    size = base
    for j in range(1, k):
        if size * base >= 1 << 62:
            values, code = np.unique(code, return_inverse=True)
            size = len(values)
        code = code[: len(ids) - j] * base + ids[j:]
        size *= base
    order = np.sort(code)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    start = np.isin(code, twice).astype(np.int64)
    cover = np.convolve(start, np.ones(k, np.int64))
    return int(np.count_nonzero(cover))


def measure(text: str | None) -> tuple:
    """STATS of one text; null counts as empty."""
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    bare = data.translate(None, SPACES)
    lines = [x for x in data.split(b"\n") if x.strip()]
    chars = len(bare.decode("utf-8", "replace")) if not bare.isascii() else len(bare)
    return (len(words), chars, len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words), len(lines))


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """The columns of df but the text, with STATS (long). Repeated rows stay; clashing columns give way."""
    df = drop_clashing(df, *STATS)
    kept = [f for f in df.schema.fields if f.name != text]
    schema = T.StructType([*kept, *[T.StructField(s, T.LongType()) for s in STATS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                rows = [measure(t) for t in b.column(b.schema.names.index(text)).to_pylist()]
                new = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([*[b.column(b.schema.names.index(f.name)) for f in kept], *new], names=[*[f.name for f in kept], *STATS])

    return df.mapInArrow(run, schema)


def features(s: np.ndarray, words: tuple[np.ndarray, np.ndarray], held: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Columns of STATS to what the forest sees: size, word length, shares of symbols and of repeats.

    Numbers of words and lines count by their rank among all rows (see counted()): long texts are rare, not odd.
    """
    n, chars, symbols, dups, repeats, lines = (s[:, i].astype(float) for i in range(6))
    one = np.maximum(n, 1)
    rank = lambda i, known: known[1][np.searchsorted(known[0], s[:, i])] / max(1, known[1][-1])
    return np.column_stack([rank(0, words), chars / one, symbols / (symbols + one), dups / np.maximum(lines, 1), repeats / one, rank(5, held)])


class Forest:
    """Isolation forest (Liu, Ting, Zhou 2008): score(x) = 2^(-mean path length / c(sample size))."""

    def __init__(self, x: np.ndarray, trees: int = TREES, size: int = SUBSAMPLE, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.size = min(size, len(x))
        # where there are enough rows, no two trees share one
        apart = len(x) >= trees * size
        own = lambda t: np.arange(t, trees * size, trees) if apart else rng.choice(len(x), self.size, replace=False)
        self.trees = [self.grow(x[own(t)], rng) for t in range(trees)] if self.size > 1 else []

    @staticmethod
    def c(n: int) -> float:
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n

    def grow(self, x: np.ndarray, rng) -> tuple:
        feature, split, left, depth = [], [], [], []  # the right child follows the left one
        todo = [(x, 0)]
        limit = int(np.ceil(np.log2(max(2, self.size))))
        at = 0
        while at < len(todo):
            part, d = todo[at]
            at += 1
            low, high = part.min(0), part.max(0)
            wide = np.flatnonzero(high > low)
            if d >= limit or len(part) < 2 or not len(wide):
                feature.append(-1), split.append(0.0), left.append(0), depth.append(d + self.c(len(part)))
                continue
            f = int(rng.choice(wide))
            cutoff = rng.uniform(low[f], high[f])
            goes = part[:, f] < cutoff
            feature.append(f), split.append(cutoff), left.append(len(todo)), depth.append(0.0)
            todo += [(part[goes], d + 1), (part[~goes], d + 1)]
        return np.array(feature), np.array(split), np.array(left), np.array(depth)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.trees or not len(x):
            return np.zeros(len(x))
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, split, left, depth in self.trees:
            node = np.zeros(len(x), int)
            while (inner := feature[node] >= 0).any():
                f = np.where(inner, feature[node], 0)
                node = np.where(inner, left[node] + (x[rows, f] >= split[node]), node)
            total += depth[node]
        return 2.0 ** (-total / len(self.trees) / self.c(self.size))


def base_failed(n_words, n_repeat_words):
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


class Model:
    """A forest over the features of rows of STATS."""

    def __init__(self, rows: np.ndarray, words: tuple[np.ndarray, np.ndarray], lines: tuple[np.ndarray, np.ndarray]):
        self.words, self.lines = words, lines
        self.forest = Forest(self.features(rows))

    def features(self, rows: np.ndarray) -> np.ndarray:
        return features(rows, self.words, self.lines)

    def score(self, rows: np.ndarray) -> np.ndarray:
        return self.forest.score(self.features(rows))


def threshold(scores: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float:
    """The score limit of best balanced accuracy among those that keep KEEP_GOOD of the good rows.

    Without bad rows, the lowest that keeps KEEP_GOOD_ALONE of the good ones; without good rows, nothing is rejected.
    """
    values = np.unique(scores[good | bad])
    return limit_of(values, *[np.bincount(np.searchsorted(values, scores[m]), minlength=len(values)) for m in (good, bad)])


def limit_of(values: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float:
    """threshold() from the distinct scores in order and the numbers of good and bad rows that have each."""
    own, junk = np.cumsum(good), np.cumsum(bad)
    if not len(own) or not own[-1]:
        return float("inf")
    if not junk[-1]:
        return float(values[np.searchsorted(own, min(own[-1] - 1, int(np.ceil(KEEP_GOOD_ALONE * own[-1]))), "right")])
    kept, found = own / own[-1], 1 - junk / junk[-1]
    return float(values[np.argmax(np.where(kept >= KEEP_GOOD, kept + found, -1))])


def counted(stats: DataFrame, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a column of numbers of words or lines, in order, and how many rows lie below each and below none.

    Rows with w words in all have at most sqrt(2 w) different numbers, which bounds what comes to the driver.
    """
    held = sorted(stats.groupBy(column).count().collect())
    return np.array([r[0] for r in held], np.int64), np.concatenate([[0], np.cumsum([r[1] for r in held], dtype=np.int64)])


def grown(stats: DataFrame, key: str = "doc_id") -> Model:
    """The forest: ranks are told by all rows, and each tree has a subsample of its own of all rows, as the method has it."""
    known, want, span = [counted(stats, c) for c in RANKED], TREES * SUBSAMPLE, 1 << 40
    draw = F.pmod(F.xxhash64(F.col(key).cast("string"), *STATS, F.lit(5)), F.lit(span)).alias("__draw")
    # so few pass that no task sends all that are wanted: these, and six standard deviations
    least = int(span * (want + 6 * want**0.5) / max(1, known[0][1][-1]))
    rows = stats.select(*STATS, draw).filter(F.col("__draw") <= least).orderBy("__draw", *STATS).select(*STATS).limit(want).collect()
    return Model(np.array(rows, dtype=np.int64).reshape(len(rows), len(STATS)), *known)


def anomalies(stats: DataFrame, model: Model) -> DataFrame:
    """stats with anomaly (0 to 1), in steps of 1 / CELLS."""
    stats = drop_clashing(stats, "anomaly")
    schema = T.StructType([*stats.schema.fields, T.StructField("anomaly", T.DoubleType())])
    shared = stats.sparkSession.sparkContext.broadcast(model)  # at most TREES x 2 SUBSAMPLE nodes, and counted() twice

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(b.schema.names.index(s)).to_numpy(zero_copy_only=False) for s in STATS])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.round(shared.value.score(x) * CELLS) / CELLS)], names=[*b.schema.names, "anomaly"])

    return stats.mapInArrow(run, schema)


def calibrated(scored: DataFrame, labels: DataFrame, key: str = "doc_id") -> float:
    """threshold() of all labelled rows: their numbers by anomaly, CELLS at most, come to the driver. Equal rows count once."""
    known = labels.filter(F.col("quality").isNotNull() & F.col(key).isNotNull()).select(F.col(key), F.col("quality").cast("int").alias("quality")).distinct()
    passing = scored.filter(f"not {FAILED}").select(key, *STATS, "anomaly").distinct()
    cells = known.join(passing, key).groupBy("anomaly").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    table = np.array(sorted(tuple(r) for r in cells.collect()), dtype=float).reshape(-1, 3)
    return limit_of(table[:, 0], table[:, 1], table[:, 2])


def fit(stats: DataFrame, labels: DataFrame, key: str = "doc_id") -> tuple[Model, float]:
    model = grown(stats, key)
    return model, calibrated(anomalies(stats, model), labels, key)


def verdicts(scored: DataFrame, limit: float) -> DataFrame:
    """Rows with their anomaly, with base_failed and kept: not base_failed, and anomaly at most the limit."""
    scored = drop_clashing(scored, "base_failed", "kept").withColumn("base_failed", F.expr(FAILED))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= F.lit(limit)))


def judge(stats: DataFrame, model: Model, limit: float) -> DataFrame:
    """stats with anomaly, base_failed and kept."""
    return verdicts(anomalies(stats, model), limit)


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics and verdict of every document. Null and empty texts have no words and fail the base rules;
    without labels the forest rejects nothing; an empty table gives an empty result."""
    stats = cut(statistics(docs.select("doc_id", "text")), "quality_statistics")
    scored = cut(anomalies(stats, grown(stats)), "quality_anomalies")
    return verdicts(scored, calibrated(scored, labels)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")
