"""Centroid clustering by sort-means, in whole numbers.

Every round orders, for each centroid, the others by their distance from it. A vector starts at the centroid it was assigned to
in the round before, at distance d, and tries the others in that order; it stops at the first one strictly beyond 2 d from there,
as by the triangle inequality neither that one nor any later can be as near as the first. Equal distances go to the smaller number,
so the bound has to be strict.

A round is one pass over the stored vectors: it writes them with their new centroid and, from each task, one row of sums a centroid.
Those rows alone, read back, give the next centroids. Nothing is shuffled but the sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.llm.common import cut, discard, trimmed

#: Components of a vector, units a component is counted in, centroids, rounds, seed of the first centroids.
DIMS, SCALE, K, ROUNDS, SEED = 64, 256, 40, 5, 2
#: Components beyond this count as this, so that squared distances of up to 64 components stay below 2^62.
LIMIT = 1 << 27
#: Vectors compared at a time.
BLOCK = 4096


class Clusters(NamedTuple):
    """assigned: key, cluster, distance of every kept vector; centroids: whole numbers, one row each; inertia: of each cluster."""

    assigned: DataFrame
    centroids: np.ndarray
    inertia: list[int]


def kept(df: DataFrame, key: str, vector: str, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """key and x, the whole numbers of each vector of `dims` components that are all there and finite."""
    v = F.col(f"`{vector}`").cast("array<double>")
    fit = (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(v, lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(F.greatest(F.lit(-2.0 * LIMIT), F.least(F.lit(2.0 * LIMIT), x * F.lit(float(scale))))))).cast("int"))
    return df.filter(fit).select(F.col(f"`{key}`").alias("key"), whole.alias("x"))


def first_centroids(vectors: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The k vectors whose keys have the smallest digests, by digest; keys that occur twice by their components, null keys last."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    rows = vectors.orderBy(digest.asc_nulls_last(), "x").limit(k).select("x").collect()
    return np.array([r["x"] for r in rows], np.int64)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


class Scan:
    """Centroids with, for each of them, the others in order of distance."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.gaps = np.array([distances(centroids, c) for c in centroids])
        self.order = np.argsort(self.gaps, axis=1, kind="stable")
        self.tried = 0

    def assign(self, x: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each vector, and its squared distance; last: where each one starts."""
        best, near = last.copy(), np.zeros(len(x), np.int64)
        for p in np.unique(last).tolist():
            rows = np.flatnonzero(last == p)
            start = distances(x[rows], self.centroids[p])
            by = np.argsort(-start, kind="stable")
            rows, start = rows[by], start[by]
            own, d, c = x[rows], start.copy(), np.full(len(rows), p)
            self.tried += len(rows)
            for j in self.order[p].tolist():
                if j == p:
                    continue
                # in whole numbers, gap > 4 start is start < ceil(gap / 4); the starts descend
                live = int(np.searchsorted(-start, -((self.gaps[p, j] + 3) // 4), "right"))
                if not live:
                    break
                new = distances(own[:live], self.centroids[j])
                self.tried += live
                won = (new < d[:live]) | ((new == d[:live]) & (j < c[:live]))
                d[:live][won], c[:live][won] = new[won], j
            best[rows], near[rows] = c, d
        return best, near


def _round(state: DataFrame, centroids: np.ndarray, kind: str) -> DataFrame:
    """state with new clusters and distances; and rows of sums (n is set there)."""
    k, dims = centroids.shape
    names = ["key", "x", "cluster", "distance", "n", "spent", "sums"]
    wide, many = pa.decimal128(38, 0), pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scan(centroids)
        n, spent, sums = np.zeros(k, np.int64), [0] * k, np.zeros((k, dims), np.int64)
        key = pa.null()
        for whole in batches:
            key = whole.schema.field(0).type
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                x = b.column(1).flatten().to_numpy().reshape(-1, dims).astype(np.int64)
                cluster, distance = scan.assign(x, b.column(2).to_numpy().astype(np.int64))
                n += np.bincount(cluster, minlength=k)
                np.add.at(sums, cluster, x)
                for j in np.unique(cluster).tolist():
                    spent[j] += sum(distance[cluster == j].tolist())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cluster.astype(np.int32)), pa.array(distance), *[pa.nulls(b.num_rows, t) for t in (pa.int64(), wide, many)]], names=names)
        met = np.flatnonzero(n)
        if len(met):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(met), key), pa.nulls(len(met), pa.list_(pa.int32())), pa.array(met.astype(np.int32)), pa.nulls(len(met), pa.int64()), pa.array(n[met]), pa.array([Decimal(spent[j]) for j in met], wide), pa.array(sums[met].tolist(), many)], names=names)

    return state.select("key", "x", "cluster").mapInArrow(trimmed(run), f"key {kind}, x array<int>, cluster int, distance long, n long, spent decimal(38,0), sums array<long>")


def _gathered(state: DataFrame, dims: int) -> dict[int, tuple[int, int, list[int]]]:
    """By cluster: vectors, their distances and components summed up; at most a row a centroid comes to the driver."""
    whole = lambda c: F.sum(c.cast("decimal(38,0)"))
    sums = F.array(*[whole(F.get("sums", F.lit(i))) for i in range(dims)])
    rows = state.filter("n is not null").groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("spent").alias("spent"), sums.alias("sums")).collect()
    return {r["cluster"]: (r["n"], int(r["spent"]), [int(s) for s in r["sums"]]) for r in rows}


def cluster(df: DataFrame, key: str = "vec_id", vector: str = "embedding", dims: int = DIMS, scale: int = SCALE, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> Clusters:
    """Clusters of all vectors after `rounds` rounds and a last assignment.

    Vectors with another number of components, or with a null or non-finite one, have no cluster. With fewer than k vectors each one
    is a centroid. Repeated keys are vectors of their own; null keys are kept. Components beyond LIMIT count as LIMIT.
    An empty table gives an empty one.
    """
    vectors = kept(df, key, vector, dims, scale)
    kind = vectors.schema["key"].dataType.simpleString()
    state = cut(vectors.withColumn("cluster", F.lit(0)), "vectors")
    centroids = first_centroids(state, k, seed).reshape(-1, dims)
    if not len(centroids):
        return Clusters(state.select("key", "cluster", F.lit(0).cast("long").alias("distance")), centroids, [])
    for number in range(rounds + 1):
        before, state = state, cut(_round(state if not number else state.filter("n is null"), centroids, kind), f"round{number}")
        discard(before)
        found = _gathered(state, dims)
        if number < rounds:
            centroids = np.array([[s // found[j][0] for s in found[j][2]] if j in found else c.tolist() for j, c in enumerate(centroids)], np.int64)
    assigned = state.filter("n is null").select("key", "cluster", "distance")
    return Clusters(assigned, centroids, [found[j][1] if j in found else 0 for j in range(len(centroids))])


def _long(n: int) -> int | None:
    return n if n < 1 << 63 else None


def report(df: DataFrame) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every kept vector, as cluster() says.

    Sums beyond a long are null. Other columns, whatever their names, are not read.
    """
    found = cluster(df)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids.tolist()]
    rows = [(j, _long(n), _long(sum(found.inertia)), s) for j, (n, s) in enumerate(zip(found.inertia, digests, strict=True))]
    told = df.sparkSession.createDataFrame(rows, "number int, cluster_inertia long, inertia long, centroid_sha256 string")
    both = found.assigned.join(F.broadcast(told), F.col("cluster") == F.col("number"))  # a row a centroid
    return both.select(F.col("key").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    far = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT row, vec_id, x, c, d FROM (SELECT v.row, v.vec_id, v.x, c.c, {far} AS d, row_number() OVER (PARTITION BY v.row ORDER BY {far}, c.c) AS rn FROM v, c{r} c) WHERE rn = 1)")
        if r < ROUNDS:
            steps.append(f"m{r} AS (SELECT c, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM (SELECT c, x, unnest(range(1, {DIMS + 1})) AS i FROM a{r}) GROUP BY c, i)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c, coalesce(y, x) AS x FROM c{r} LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS y FROM m{r} GROUP BY c) USING (c))")
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {DIMS}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), x) - 1 AS c, x FROM v QUALIFY c < {K}),
{", ".join(steps)}
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(k.x, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN (SELECT c, x FROM c{ROUNDS}) k USING (c)
"""


ORACLE_SQL = _sql()
