"""Centroid clustering with a pivot table (LAESA).

Vectors become integers, floor(256 x).  The distances of a vector to a few fixed
pivots are computed once and stored beside it.  In each round the centroids'
distances to the pivots give, by the triangle inequality, a lower bound for every
(vector, centroid): the greatest |d(vector, pivot) - d(centroid, pivot)|.  The
centroid of the least bound gets an exact integer distance first; of the others
only those whose bound does not exceed it.  The nearest of these wins, ties by
the smaller number, so the result is that of the full comparison.

Each round is one pass over the stored table.  A task hands on one row of sums
and a count per centroid and batch, so what is exchanged and collected is bounded
by the number of centroids, whichever cluster holds most rows.  Pivots are chosen
from the first centroids, farthest first.

Defined results: vectors of another length, with a null or non-finite component,
or null, are not kept.  Nor are those with |floor(256 x)| above 2^27, whose
squared distances a long cannot hold.  Rows without vec_id are assigned but never
start a centroid; rows that repeat an id count as often as they stand there and
may start several centroids (ties of the hash by components).  Fewer rows than
centroids give fewer centroids; without any, cluster and distances are null.  An
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jetlake.llm.common import columns, dropped, long_list, slices, staged

DIMENSIONS, CENTROIDS, ROUNDS, PIVOTS, SEED = 64, 40, 5, 16, 2
LIMIT = 2**27
PAIRS = 1 << 14  # exact distances computed at once
_SLACK = 1e-6    # more than the rounding of a square root of a 62-bit integer relative to its size


def integer_vectors(table: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, v): the vectors that are kept, as integers."""
    rows = columns(table, "vec_id", "embedding").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    fits = (F.size("x") == dimensions) & F.forall("x", lambda x: x.isNotNull() & (F.abs(x) <= LIMIT / 256))
    rows = rows.where(F.when(F.col("x").isNotNull(), fits).otherwise(False))
    return rows.select("vec_id", F.transform("x", lambda x: F.floor(x * 256)).alias("v"))


def first_centroids(vectors: DataFrame, count: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The vectors whose ids have the least sha256, in that order."""
    hashed = vectors.where("vec_id is not null").select(
        F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "v")
    found = hashed.orderBy("h", "v").limit(count).collect()
    return np.array([row.v for row in found], np.int64)


def farthest_first(points: np.ndarray, count: int) -> np.ndarray:
    """At most ``count`` distinct points, each the farthest from those before it."""
    chosen, gap = [], np.full(len(points), np.iinfo(np.int64).max)
    while len(points) and len(chosen) < count and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


def pivot_distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances (vectors, pivots)."""
    found = np.empty((len(vectors), len(pivots)))
    for k, pivot in enumerate(pivots):
        found[:, k] = np.sqrt(((vectors - pivot) ** 2).sum(axis=1))
    return found


def nearest(vectors: np.ndarray, table: np.ndarray, centroids: np.ndarray, pivots: np.ndarray):
    """Number and squared distance of the nearest centroid, and how many exact distances that took."""
    of_centroids = pivot_distances(centroids, pivots)
    bounds = np.zeros((len(vectors), len(centroids)))
    for k in range(len(pivots)):
        np.maximum(bounds, np.abs(table[:, k, None] - of_centroids[None, :, k]), out=bounds)
    every = np.arange(len(vectors))
    guess = bounds.argmin(axis=1)
    best = ((vectors - centroids[guess]) ** 2).sum(axis=1)
    reach = np.sqrt(best) * (1 + _SLACK) + _SLACK
    open_ = bounds * (1 - _SLACK) <= reach[:, None]
    open_[every, guess] = False
    rows, numbers = np.nonzero(open_)
    found = np.full(bounds.shape, np.iinfo(np.int64).max)
    found[every, guess] = best
    for start in range(0, len(rows), PAIRS):
        r, c = rows[start:start + PAIRS], numbers[start:start + PAIRS]
        gap = vectors[r] - centroids[c]
        found[r, c] = np.einsum("ij,ij->i", gap, gap)
    cluster = found.argmin(axis=1)  # the first of equal ones
    return cluster, found[every, cluster], len(vectors) + len(rows)


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _with_pivots(batches, pivots):
    for batch in slices(batches, 4096):
        found = pivot_distances(_matrix(batch.column("v"), pivots.shape[1]), pivots)
        offsets = pa.array(np.arange(0, found.size + 1, len(pivots)), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("v"), pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))],
            names=["vec_id", "v", "d"])


def _sums(batches, centroids, pivots):
    """One row of sums per centroid and task: (cluster, rows, exact, sums)."""
    count, width = centroids.shape
    rows, exact, sums = np.zeros(count, np.int64), 0, np.zeros((count, width), np.int64)
    for batch in slices(batches, 4096):
        vectors = _matrix(batch.column("v"), width)
        cluster, _, tried = nearest(vectors, _matrix(batch.column("d"), len(pivots)), centroids, pivots)
        order = np.argsort(cluster, kind="stable")
        present, starts = np.unique(cluster[order], return_index=True)
        sums[present] += np.add.reduceat(vectors[order], starts, axis=0)
        rows += np.bincount(cluster, minlength=count)
        exact += tried
    some = np.flatnonzero(rows)
    if len(some):
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array(rows[some]), pa.array([exact] + [0] * (len(some) - 1), pa.int64()),
             long_list(list(range(0, len(some) * width + 1, width)), sums[some].ravel())],
            names=["cluster", "rows", "exact", "sums"])


def moved(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, int]:
    """The centroids after a round, and the number of exact distances it took."""
    width = centroids.shape[1]
    parts = table.mapInArrow(lambda batches: _sums(batches, centroids, pivots),
                             "cluster int, rows long, exact long, sums array<long>")
    total = parts.groupBy("cluster").agg(
        F.sum("rows").alias("rows"), F.sum("exact").alias("exact"),
        F.array(*(F.sum(F.col("sums")[k].cast("decimal(38,0)")).cast("string") for k in range(width))).alias("sums"))
    after, exact = centroids.copy(), 0
    for row in total.collect():  # one row per centroid
        after[row.cluster] = [int(x) // row.rows for x in row.sums]
        exact += row.exact
    return after, exact


def _assigned(batches, centroids, pivots):
    for batch in slices(batches, 4096):
        cluster, distance, _ = nearest(_matrix(batch.column("v"), centroids.shape[1]),
                                       _matrix(batch.column("d"), len(pivots)), centroids, pivots)
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())],
            names=["vec_id", "cluster", "distance"])


def centroid_digest(centroid) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def cluster_vectors(table: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, pivots: int = PIVOTS,
                    dimensions: int = DIMENSIONS, seed: int = SEED) -> tuple[DataFrame, np.ndarray, list[int]]:
    """(vec_id, cluster, distance) staged, the final centroids, and the exact distances of each round."""
    vectors = integer_vectors(table, dimensions)
    centres = first_centroids(vectors, centroids, seed)
    if not len(centres):
        nothing = vectors.select("vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance"))
        return nothing, centres.reshape(0, dimensions), []
    chosen = farthest_first(centres, pivots)
    stored = staged(vectors.mapInArrow(lambda batches: _with_pivots(batches, chosen),
                                       "vec_id long, v array<long>, d array<double>"), "vectors")
    exact = []
    for _ in range(rounds):
        centres, tried = moved(stored, centres, chosen)
        exact.append(tried)
    final = centres
    assigned = staged(stored.mapInArrow(lambda batches: _assigned(batches, final, chosen),
                                        "vec_id long, cluster int, distance long"), "assigned")
    dropped(stored)
    return assigned, centres, exact


def clustered(table: DataFrame, **options) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    assigned, centres, _ = cluster_vectors(table, **options)
    sums = {r.cluster: r.s for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    total = sum(s for s in sums.values() if s is not None)
    facts = [(k, sums.get(k, 0), total, centroid_digest(c)) for k, c in enumerate(centres)]  # one row per centroid
    facts = table.sparkSession.createDataFrame(
        facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster", "left").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
