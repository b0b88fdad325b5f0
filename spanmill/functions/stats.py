"""Statistics as Columns, and the distribution functions Spark lacks, applied to small aggregated frames."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def t_statistic(d: Column) -> Column:
    """Aggregate: mean over its standard error; null for fewer than two values or no variance."""
    return F.try_divide(F.avg(d), F.stddev_samp(d) / F.sqrt(F.count(d)))


def cohens_d(d: Column) -> Column:
    """Aggregate: mean over sample deviation, 0 where that is 0 or undefined."""
    return F.coalesce(F.try_divide(F.avg(d), F.stddev_samp(d)), F.lit(0.0))


def cohens_d_population(d: Column, floor: float | None = 1e-9) -> Column:
    """Aggregate: mean over population deviation; a deviation of 0 counts as floor, or gives null without one."""
    sd = F.stddev_pop(d)
    return F.try_divide(F.avg(d), sd if floor is None else F.when(sd == 0, floor).otherwise(sd))


def normal_margin(d: Column) -> Column:
    """Aggregate: 1.96 population deviations over the root of the count."""
    return F.try_divide(1.96 * F.stddev_pop(d), F.sqrt(F.count(d)))


def share_positive(d: Column) -> Column:
    """Aggregate: per cent of values above 0."""
    return F.try_divide(100 * F.count_if(d > 0), F.count(d))


def safe_corr(x: Column, y: Column) -> Column:
    """Aggregate: Pearson's r; null for fewer than two rows or without variance."""
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when(F.count(F.when(x.isNotNull() & y.isNotNull(), 1)) >= 2, r)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised, by the continued fraction of Lentz's method."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 0.0
    f = 1.0
    for i in range(400):
        m = i // 2
        if i == 0:
            step = 1.0
        elif i % 2 == 0:
            step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + step * d
        d = 1 / (d if abs(d) > tiny else tiny)
        c = 1 + step / (c if abs(c) > tiny else tiny)
        f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * (f - 1)


def t_two_sided(t: float | None, df: float) -> float | None:
    """p of Student's t."""
    if t is None or math.isnan(t) or df < 1:
        return None
    return 0.0 if math.isinf(t) else incomplete_beta(df / 2, 0.5, df / (df + t * t))


def t_quantile(df: float, level: float = 0.95) -> float | None:
    """The t beyond which lies half of what level leaves, by bisection."""
    if df < 1:
        return None
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_two_sided(mid, df) > 1 - level else (low, mid)
    return (low + high) / 2


def with_t(df: DataFrame, n: str = "n", t: str | None = None, level: float = 0.95) -> DataFrame:
    """df, a small aggregated frame, with t_crit for n - 1 degrees of freedom, and p if t names a statistic."""
    extra = "t_crit double" + (", p double" if t else "")
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema.fields)}, {extra}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            x = x.assign(t_crit=[t_quantile(k - 1, level) for k in x[n]])
            if t:
                x = x.assign(p=[t_two_sided(None if pd.isna(v) else float(v), k - 1) for v, k in zip(x[t], x[n], strict=True)])
            yield x

    return df.mapInPandas(run, schema)


def appendix(grouped, delta: str = "delta", by: tuple = ("model", "comparison")) -> DataFrame:
    """Of a grouped frame of paired differences: the groups with t, p, d (population) and pct above 0, and each as a line of a LaTeX table.

    Without variance t, p and d are null and show as "-".
    """
    c = F.col(delta)
    agg = grouped.agg(F.count(c).alias("n"), t_statistic(c).alias("t"), cohens_d_population(c, None).alias("d"), share_positive(c).alias("pct"))
    told = with_t(agg, "n", "t")
    p = F.when(F.col("p") < 1e-4, "<0.0001").otherwise(F.round("p", 4).cast("string"))
    shown = lambda form, x: F.coalesce(F.concat(F.lit("$"), F.format_string(form, x), F.lit("$")), F.lit("-"))
    name = F.replace(F.col(by[0]), F.lit("_"), F.lit("\\_"))
    p_tex = F.when(F.col("p").isNull(), "-").when(F.col("p") < 1e-4, "$<0.0001$").otherwise(F.concat(F.lit("$"), F.format_string("%.3f", "p"), F.lit("$")))
    num = {x: F.when(F.col(x).isNotNull(), F.col(x)) for x in ("t", "d")}
    line = F.concat(name, F.lit(" & "), F.col(by[1]), F.lit(" & "), F.when(num["t"].isNull(), "-").otherwise(shown("%+.2f", num["t"])), F.lit(" & "), p_tex, F.lit(" & "), F.when(num["d"].isNull(), "-").otherwise(shown("%+.3f", num["d"])), F.lit(" & "), F.format_string("%.1f", "pct"), F.lit("\\% \\\\"))
    return told.select(*by, F.round("t", 2).alias("t"), p.alias("p"), F.round("d", 3).alias("d"), F.round("pct", 1).alias("pct"), line.alias("line"))


def confidence(df: DataFrame, by: list[str], value: str, margin_wanted: float = 0.02, level: float = 0.95) -> DataFrame:
    """Mean with its t interval, and two readings of how many samples a wanted margin needs.

    required_if_short is n where the margin is met already; required_always is the formula, but more than n
    where it is not met. Fewer than two values, or no variance: no margin.
    """
    agg = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    out = with_t(agg, "n", None, level)
    margin = F.coalesce(F.col("t_crit") * F.col("sd") / F.sqrt("n"), F.lit(0.0))
    formula = F.ceil(F.pow(F.col("t_crit") * F.col("sd") / margin_wanted, 2))
    out = out.withColumn("margin", margin).withColumns({"low": F.col("mean") - F.col("margin"), "high": F.col("mean") + F.col("margin"), "enough": F.col("margin") <= margin_wanted})
    need = F.coalesce(formula, F.col("n"))
    return out.withColumns({"required_if_short": F.when(F.col("enough"), F.col("n")).otherwise(need), "required_always": F.when(F.col("enough"), need).otherwise(F.greatest(F.col("n") + 1, need))})


#: Poisson(1) below these limits of a uniform number is 0, 1, ... 6; from the last one on it is 7.
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(7)])
#: Rows read at once, and groups whose sums a task holds before it passes them on.
CHUNK, HELD = 2048, 500


def weights(keys: np.ndarray, draws: int) -> np.ndarray:
    """Poisson(1) weights of 64-bit hashes of keys (rows) in each draw (columns), by the finalizer of SplitMix64."""
    z = keys.astype(np.uint64)[:, None] + np.arange(1, draws + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((z ^ (z >> np.uint64(31))) >> np.uint64(24)).astype(float) / float(1 << 40)
    return np.searchsorted(POISSON, u, "right").astype(float)


def bootstrap(df: DataFrame, by: list[str], value: str, key: str, draws: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """Percentile interval of the mean over seeded resamples.

    A resample gives each row a Poisson(1) weight that a hash of (seed, draw, key) decides: the usual bootstrap
    for large tables, without collecting a group anywhere. Tasks sum per group and draw in one pass; only sums are
    shuffled. Null values have no weight.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("__v"), F.xxhash64(F.lit(seed), F.col(key).cast("string")).alias("__h"))
    schema = T.StructType([*rows.schema.fields[: len(by)], T.StructField("__w", T.ArrayType(T.DoubleType())), T.StructField("__s", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        kinds: list = []

        def out() -> pa.RecordBatch:
            cols = [pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)] if by else []
            sums = [pa.array([x[i] for x in held.values()], pa.list_(pa.float64())) for i in (0, 1)]
            return pa.RecordBatch.from_arrays([*cols, *sums], names=[*by, "__w", "__s"])

        for whole in batches:
            kinds = [whole.schema.field(i).type for i in range(len(by))]
            for at in range(0, whole.num_rows, CHUNK):
                b = whole.slice(at, CHUNK)
                groups = list(zip(*(b.column(i).to_pylist() for i in range(len(by))), strict=True)) if by else [()] * b.num_rows
                place: dict = {}
                g = np.array([place.setdefault(x, len(place)) for x in groups])
                v = b.column(len(by)).to_numpy(zero_copy_only=False).astype(float)
                there = np.asarray(b.column(len(by)).is_valid())
                keys, k = np.unique(b.column(len(by) + 1).to_numpy(zero_copy_only=False).view(np.uint64), return_inverse=True)
                # group x key tables, so that a key's weights are made once for all its groups
                n, total = np.zeros((2, len(place), len(keys)))
                np.add.at(n, (g[there], k[there]), 1)
                np.add.at(total, (g[there], k[there]), v[there])
                w = weights(keys, draws)
                for x, n_w, n_s in zip(place, n @ w, total @ w, strict=True):
                    if x in held:
                        held[x][0] += n_w
                        held[x][1] += n_s
                    else:
                        held[x] = [n_w.copy(), n_s.copy()]
                if len(held) > HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    each = rows.mapInArrow(run, schema).select(*by, F.posexplode(F.arrays_zip("__w", "__s")).alias("draw", "__x"))
    means = each.groupBy(*by, "draw").agg(F.try_divide(F.sum("__x.__s"), F.sum("__x.__w")).alias("mean"))
    low = (1 - level) / 2
    return means.groupBy(*by).agg(F.percentile("mean", F.lit(low)).alias("low"), F.percentile("mean", F.lit(1 - low)).alias("high"))
