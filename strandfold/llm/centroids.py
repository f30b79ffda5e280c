"""Centroid clustering in exact integers; assignments are pruned by Ptolemaic pivots.

Every vector keeps its distances to a few fixed pivots. For pivots p, s and any vectors x, c Ptolemy's inequality gives
d(x, c) * d(p, s) >= |d(x, p) * d(c, s) - d(x, s) * d(c, p)|: with the cached distances of x and the same few of a
centroid, each pair of pivots bounds d(x, c) from below without a look at their components. A vector is compared exactly
with the centroid of its smallest bound; another centroid is compared only if its bound does not exceed what was found.
Bounds are rounded down and what they are held against is rounded up by more than floating point can lose, so nothing
that is nearest, or as near, is pruned, and distances that decide are integers. Pivots stay the same in all rounds, hence
their distances are computed once.

A round is one pass over the stored vectors: each task adds up its own vectors per cluster, and only these sums, clusters
times components a task, are shuffled. Any vector may be as frequent as it likes. The driver holds pivots and centroids.

Defined cases: a null vector, one of another length, or one with a null, NaN or infinite component is left out; a
component beyond 2^27 after scaling raises an error, as squared distances would not fit a long; repeated rows count as
often as they are there; of equally near centroids the smaller number is taken, of vectors with equal ids at the start
the smaller vector first; a row without an id is clustered but never a first centroid; with fewer vectors than
clusters there are fewer clusters; an empty cluster keeps its centroid; an empty table gives no rows. Other columns of the
input are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import local_table, materialise

#: Components beyond this are refused.
LARGEST = 1 << 27
#: More than what a handful of operations on doubles can lose, as a share.
SLACK = 2.0**-44


@dataclass(frozen=True)
class Settings:
    """``candidates``: rows, chosen by hash, among which up to ``pivots`` different vectors are looked for."""

    clusters: int = 16
    rounds: int = 3
    dimensions: int = 64
    scale: int = 64
    seed: int = 1
    pivots: int = 6
    candidates: int = 64


def whole_vectors(vectors: DataFrame, settings: Settings = Settings(), vec: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, vector`` of the vectors that count: components times ``scale``, rounded down."""
    given = vectors.select(F.col(f"`{vec}`").cast("bigint").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False)))
    scaled = F.transform("x", lambda v: F.floor(v * settings.scale))
    small = F.forall("x", lambda v: F.abs(v * settings.scale) <= LARGEST)
    checked = F.when(small, scaled).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST}")))
    return given.filter((F.size("x") == settings.dimensions) & finite).select("vec_id", checked.cast("array<int>").alias("vector"))


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of two integer matrices, or of all rows to one vector."""
    return np.square(x.astype(np.int64) - y).sum(axis=-1)


def _least_hashes(whole: DataFrame, salt: str, n: int) -> list[list[int]]:
    named = whole.filter("vec_id IS NOT NULL").withColumn("hash", F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256))
    return [r["vector"] for r in named.orderBy("hash", "vector").limit(n).collect()]


@dataclass(frozen=True)
class Pivots:
    """Pivot vectors, and for each pair (p, s) of different ones their distance."""

    vectors: np.ndarray
    pairs: tuple[tuple[int, int, float], ...]

    @staticmethod
    def of(rows: list[list[int]], settings: Settings) -> Pivots:
        different = list(dict.fromkeys(map(tuple, rows)))[: settings.pivots]
        vectors = np.array(different, dtype=np.int64).reshape(len(different), settings.dimensions)
        return Pivots(vectors, tuple((p, s, float(np.sqrt(squared(vectors[p], vectors[s])))) for p, s in combinations(range(len(different)), 2)))

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared and exact, a column per pivot."""
        return np.stack([squared(x, p) for p in self.vectors], axis=1) if len(self.vectors) else np.zeros((len(x), 0), dtype=np.int64)

    def bounds(self, of_vectors: np.ndarray, of_centroids: np.ndarray) -> np.ndarray:
        """Squared distances of vectors to centroids are not below these, from their squared distances to the pivots."""
        x, c = np.sqrt(of_vectors.astype(float)), np.sqrt(of_centroids.astype(float))
        out = np.zeros((len(x), len(c)))
        for p, s, gap in self.pairs:
            one, two = np.outer(x[:, p], c[:, s]), np.outer(x[:, s], c[:, p])
            np.maximum(out, (np.abs(one - two) - SLACK * (one + two)) / gap, out=out)
        return np.square(out) * (1 - SLACK)


def nearest(x: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, pivots: Pivots) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row the number of the nearest centroid, its squared distance, and how many centroids were compared exactly."""
    bounds = pivots.bounds(to_pivots, pivots.distances(centroids))
    first = bounds.argmin(axis=1)
    cluster, best = first.copy(), squared(x, centroids[first])
    checked = np.ones(len(x), dtype=np.int64)
    for c in range(len(centroids)):
        own = np.flatnonzero((bounds[:, c] <= best * (1 + SLACK)) & (first != c))
        d = squared(x[own], centroids[c])
        better = (d < best[own]) | ((d == best[own]) & (c < cluster[own]))
        cluster[own[better]], best[own[better]] = c, d[better]
        checked[own] += 1
    return cluster, best, checked


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


PIVOTED = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("vector", T.ArrayType(T.IntegerType())), T.StructField("to_pivots", T.ArrayType(T.LongType()))])


def with_pivots(whole: DataFrame, pivots: Pivots, settings: Settings) -> DataFrame:
    """``whole`` with the squared distances to the pivots, stored."""

    def run(batches):
        for batch in batches:
            far = pivots.distances(_matrix(batch.column("vector"), settings.dimensions))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(far) + 1) * far.shape[1], pa.int32()), pa.array(far.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), lists], names=PIVOTED.names)

    return materialise(whole.mapInArrow(run, PIVOTED), "pivoted")


ASSIGNED = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType()), T.StructField("checked", T.LongType())])


def _nearest(batch: pa.RecordBatch, centroids: np.ndarray, pivots: Pivots) -> tuple[np.ndarray, ...]:
    x = _matrix(batch.column("vector"), centroids.shape[1])
    return x, *nearest(x, _matrix(batch.column("to_pivots"), len(pivots.vectors)), centroids, pivots)


def assign(pivoted: DataFrame, centroids: np.ndarray, pivots: Pivots) -> DataFrame:
    """``vec_id, cluster, distance`` (squared) and ``checked``, the number of centroids that were compared exactly."""

    def run(batches):
        for batch in batches:
            _, cluster, best, checked = _nearest(batch, centroids, pivots)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(best), pa.array(checked)], names=ASSIGNED.names)

    return pivoted.mapInArrow(run, ASSIGNED)


SUMS = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("at", T.IntegerType()), T.StructField("total", T.LongType()), T.StructField("n", T.LongType())])


def moved(pivoted: DataFrame, centroids: np.ndarray, pivots: Pivots) -> np.ndarray:
    """The centroids after a round: floors of the exact means of what is assigned to them."""
    k, width = centroids.shape

    def run(batches):
        total, n = np.zeros((k, width), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            x, cluster, _, _ = _nearest(batch, centroids, pivots)
            order = np.argsort(cluster, kind="stable")
            own, first = np.unique(cluster[order], return_index=True)
            if len(own):
                total[own] += np.add.reduceat(x[order], first, axis=0)
                n += np.bincount(cluster, minlength=k)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.arange(k), width), pa.int32()), pa.array(np.tile(np.arange(width), k), pa.int32()), pa.array(total.reshape(-1)), pa.array(np.repeat(n, width)),
        ], names=SUMS.names)

    sums = pivoted.mapInArrow(run, SUMS).groupBy("cluster", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in sums.collect():  # clusters times components
        if r["n"]:
            out[r["cluster"], r["at"]] = int(r["total"]) // r["n"]
    return out


@dataclass(frozen=True)
class Clustering:
    """``assigned``: vec_id, cluster, distance, checked, stored; ``centroids``: a row per cluster."""

    assigned: DataFrame
    centroids: np.ndarray

    def hashes(self) -> list[str]:
        """SHA-256 of each centroid's components, as decimal integers between commas."""
        return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.centroids.tolist()]

    def described(self) -> DataFrame:
        """``assigned`` plus ``cluster_inertia``, ``inertia`` and ``centroid_sha256``."""
        spark = self.assigned.sparkSession
        sums = {r["cluster"]: r["total"] for r in self.assigned.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
        n = range(len(self.centroids))
        known = local_table(spark, cluster=pa.array(n, pa.int32()), cluster_inertia=pa.array([sums.get(c, 0) for c in n], pa.int64()), inertia=pa.array([sum(sums.values())] * len(n), pa.int64()), centroid_sha256=pa.array(self.hashes(), pa.string()))
        return self.assigned.join(F.broadcast(known), "cluster")  # a row per cluster


def cluster(vectors: DataFrame, settings: Settings = Settings(), vec: str = "vec_id", embedding: str = "embedding") -> Clustering:
    """Start from the vectors of the least hashes, move the centroids ``rounds`` times, and assign once more."""
    whole = whole_vectors(vectors, settings, vec, embedding)
    first = _least_hashes(whole, f"{settings.seed}:", settings.clusters)
    pivots = Pivots.of(_least_hashes(whole, f"pivot {settings.seed}:", settings.candidates), settings)
    centroids = np.array(first, dtype=np.int64).reshape(len(first), settings.dimensions)
    if not len(centroids):
        # Without an id no vector can be a first centroid, so there is none to go to.
        return Clustering(vectors.sparkSession.createDataFrame([], ASSIGNED), centroids)
    pivoted = with_pivots(whole, pivots, settings)
    for _ in range(settings.rounds):
        centroids = moved(pivoted, centroids, pivots)
    return Clustering(materialise(assign(pivoted, centroids, pivots), "assigned"), centroids)
