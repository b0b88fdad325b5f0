"""Shared helpers: table reading, the shared work folder and lineage cuts."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanmill.sources.paths import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, lost executors recompute nothing.

    The shuffle files behind it go as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{re.sub(r'[^A-Za-z0-9_]', '_', name)}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what cut() wrote; nothing that is still to be computed may read it."""
    for df in frames:
        if path := getattr(df, "cut_path", None):
            jvm, spark = df.sparkSession._jvm, df.sparkSession._jsparkSession
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sessionState().newHadoopConf()).delete(where.getParent(), True)


#: Tables of a worker that it can make anew: trim() empties them.
TABLES: list = []


def trim() -> None:
    """Gives back the memory that a Python worker no longer uses; idle workers stay alive beside those of the next stage."""
    for t in TABLES:
        t.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def trimmed(run: Callable) -> Callable:
    """run, a function of Arrow batches, with trim() at the end of each task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.enable()
            trim()

    return task


def drop_clashing(df: DataFrame, *names: str) -> DataFrame:
    """Input columns that bear the name of a result column give way to it (case-insensitively)."""
    low = {n.lower() for n in names}
    keep = [c for c in df.columns if c.lower() not in low]
    return df.select(*[F.col(f"`{c}`") for c in keep])


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def n_words(c: Column) -> Column:
    """Words of a text, by ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(c, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def running(df: DataFrame, keys: list[str], order: list[Column], place: str, **sums: str) -> DataFrame:
    """df with each row's place (from 1) among the rows of its keys, and running sums up to it (new name=column).

    Rows are dealt by ranges of keys and order, so that a key with very many rows is numbered in many tasks; what the
    earlier ranges of a key hold is added to each. Only keys that cross a border have such a row: at most one a range.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(parts, *[F.col(k) for k in keys], *order).withColumn("__part", F.spark_partition_id()), "dealt")
    local = Window.partitionBy("__part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumns({place: F.count(F.lit(1)).over(local), **{new: F.sum(c).over(local) for new, c in sums.items()}})
    held = dealt.groupBy("__part", *keys).agg(F.count(F.lit(1)).alias(place), *[F.sum(c).alias(new) for new, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    own = [place, *sums]
    late = held.select(F.col("__part").alias("__p"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[F.sum(c).over(before).alias(f"__{c}") for c in own]).filter(f"`__{place}` is not null")
    met = [F.col("__part") == F.col("__p"), *[F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]]
    both = out.join(F.broadcast(late), met, "left")
    return both.select(*df.columns, *[(F.col(c) + F.coalesce(F.col(f"__{c}"), F.lit(0))).alias(c) for c in own])


def hex_sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


#: Slices in which summed() adds up its tables.
SLICES = 64


def summed(df: DataFrame, column: str, bits: int, places, marks: bool = False) -> np.ndarray:
    """How often places(arrow column) names each of 2^bits places over all rows, at most 2^32 - 1; or, as marks, whether.

    Every task keeps one table of that size; slices of the tables are then added up, one group a slice.
    """
    size = 1 << bits
    part = size // SLICES

    def pack(x: np.ndarray) -> bytes:
        if marks:
            return np.packbits(x).tobytes()
        x = np.minimum(x, 0xFFFFFFFF)
        return x.astype("<u1" if x.max() < 1 << 8 else "<u2" if x.max() < 1 << 16 else "<u4").tobytes()

    def unpack(x) -> np.ndarray:
        return np.unpackbits(np.frombuffer(x, np.uint8)).astype(bool) if marks else np.frombuffer(x, f"<u{len(x) // part}").astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, bool if marks else np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                p = places(b.column(0).slice(at, 2000))
                if marks:
                    total[p] = True
                elif len(p):
                    total += np.bincount(p, minlength=size)
        rows = [(i, x) for i in range(SLICES) if (x := total[i * part : (i + 1) * part]).any()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([pack(x) for _, x in rows], pa.binary())], names=["slice", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                total[i] = total[i] + unpack(x.as_buffer()) if i in total else unpack(x.as_buffer())
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([pack(x) for x in total.values()], pa.binary())], names=["slice", "sums"])

    schema = "slice int, sums binary"
    out = np.zeros(size, bool if marks else np.int64)
    for i, x in df.select(column).mapInArrow(count, schema).repartition(SLICES // 4, "slice").mapInArrow(add, schema).collect():
        out[i * part : (i + 1) * part] += unpack(x)
    return np.packbits(out) if marks else np.minimum(out, 0xFFFFFFFF).astype(np.uint32)


#: Bits of a filter by marks for each of its spots, and at most (as a power of two).
FILTER_EACH, FILTER_BITS = 16, 27
U = np.uint64
MIX1, MIX2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def _spots(ids: np.ndarray, bits: int) -> np.ndarray:
    x = ids.view(U)
    x = (x ^ (x >> U(30))) * MIX1  # splitmix64 (public domain)
    x = (x ^ (x >> U(27))) * MIX2
    return ((x ^ (x >> U(31))) & U((1 << bits) - 1)).astype(np.int64)


class Marks:
    """Marks of FILTER_EACH bits for each of the spots (by the named columns), at most 2^FILTER_BITS; of more spots they leave out fewer."""

    def __init__(self, spots: DataFrame, *by: str):
        ids = spots.select(F.xxhash64(*(by or ("row", "line"))).alias("__id"))
        many = ids.agg(F.approx_count_distinct("__id")).head()[0]
        bits = self.bits = min(FILTER_BITS, max(10, (FILTER_EACH * many).bit_length()))
        table = summed(ids, "__id", bits, lambda c: _spots(c.to_numpy(zero_copy_only=False), bits), marks=True)
        self.table = spots.sparkSession.sparkContext.broadcast(table)

    def tester(self) -> Callable[[pa.Array], np.ndarray]:
        """A function from hashes (xxhash64 of the columns) to whether each may be a spot's."""
        bits, table = self.bits, self.table

        def test(ids: pa.Array) -> np.ndarray:
            p = _spots(ids.to_numpy(zero_copy_only=False), bits)
            return (table.value[p >> 3] >> (7 - (p & 7)).astype(np.uint8) & 1).astype(bool)

        return test

    def maybe(self, *by: Column) -> Column:
        """Whether a row may be among the spots. Only a hash of the row goes to the Python worker, not its other columns."""
        test = self.tester()

        @F.arrow_udf("boolean")
        def met(ids: pa.Array) -> pa.Array:
            return pa.array(test(ids))

        return met(F.xxhash64(*by))

    def picked(self, df: DataFrame, inside: bool = True) -> DataFrame:
        """The rows of df whose row and line are among the spots, and some others; or else all the rest."""
        met = self.maybe(F.col("row"), F.col("line"))
        return df.filter(met if inside else ~met)
