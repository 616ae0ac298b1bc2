"""Centroid clustering of vectors by sort-means, in whole numbers.

A vector is kept when it has `DIMENSIONS` components, all of them finite; each component x becomes
floor(1024 x). Centroids begin as the kept vectors whose ids have the smallest hashes. In every round
each centroid's others are put in order of their distance from it; a vector's scan starts at the
centroid it had in the round before, goes through the others in that order and stops at the first
that is strictly beyond twice the vector's distance from its old centroid: by the triangle inequality
none from there on is nearer, nor as near. A round's centroids are the floors of exact means.

A round is one pass over the vectors: tasks add up their vectors by cluster and send CLUSTERS x
DIMENSIONS sums each; nothing else is exchanged, and no vector moves. The driver holds the centroids
of all rounds (rounds x clusters x dimensions numbers, none of which grows with the input). A task
gets a vector's old assignment by replaying the earlier rounds on its batch, mostly one or two
distances a round, so that no assignments are written and read again: a pass only reads its input, and
a lost executor costs the tasks that it was running. For long runs, where replaying is dearer than
writing, `assign` takes and gives the assignments themselves.

Edge cases: null, short, long, NaN or infinite vectors are left out; a null vec_id is kept and hashed
as an empty id; rows that repeat a vec_id each count (the seeds' ties go by the vectors); equal distances go
to the smaller number; empty clusters keep their centroid; with fewer vectors than clusters there are as
many clusters as vectors; components beyond +-2^27 (x beyond 131072) are held there, so that squared
distances fit a long; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLUSTERS, ROUNDS, DIMENSIONS, SEED, SCALE = 8, 10, 64, 3, 1024
#: Whole components are held within so much; within EXACT, sums of their products are exact doubles.
MOST, EXACT = 1 << 27, 1 << 22
#: Vectors whose distances are worked out together.
BLOCK = 4096

Matrix = np.ndarray


def integers(column: pa.Array, dimensions: int = DIMENSIONS) -> tuple[Matrix, Matrix]:
    """Positions of the rows that are kept, and their whole components, a row each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = np.flatnonzero(np.asarray(column.value_lengths().fill_null(-1)) == dimensions)
    flat = column.take(pa.array(rows)).flatten()
    x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dimensions)  # nulls become NaN
    fine = np.isfinite(x).all(1)
    return rows[fine], np.clip(np.floor(x[fine] * SCALE), -MOST, MOST).astype(np.int64)


def _distances(x: Matrix, norms: Matrix, centroids: Matrix, lengths: Matrix, to: Matrix) -> Matrix:
    """Squared distance of each row of x from its centroid."""
    out = np.empty(len(x), x.dtype)
    for c in np.unique(to):
        of = np.flatnonzero(to == c)
        out[of] = norms[of] - 2 * ((x if len(of) == len(x) else x[of]) @ centroids[c]) + lengths[c]
    return out


def assign(x: Matrix, centroids: Matrix, before: Matrix) -> tuple[Matrix, Matrix, int]:
    """Nearest centroid and squared distance of each row, scanned from the assignment before, and how many distances that took."""
    kind = np.float64 if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT else np.int64
    x, c = x.astype(kind), centroids.astype(kind)
    norms, lengths = (x * x).sum(1), (c * c).sum(1)
    gaps = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(2)
    order = np.lexsort((np.broadcast_to(np.arange(len(c)), gaps.shape), gaps))
    # A centroid itself heads its own order, even where another coincides with it.
    order = np.array([[i, *(j for j in row if j != i)] for i, row in enumerate(order.tolist())])
    near = -(-np.take_along_axis(gaps, order, 1) // 4)  # rounded up: beyond twice the distance iff this is more than its square
    first = _distances(x, norms, c, lengths, before)
    best, least, took = before.copy(), first.copy(), len(x)
    still = np.arange(len(x))
    for place in range(1, len(c)):
        still = still[near[before[still], place] <= first[still]]
        if not len(still):
            break
        to = order[before[still], place]
        d = _distances(x[still], norms[still], c, lengths, to)
        took += len(still)
        better = (d < least[still]) | ((d == least[still]) & (to < best[still]))
        won = still[better]
        best[won], least[won] = to[better], d[better]
    return best, least.astype(np.int64), took


def _replayed(x: Matrix, history: list[Matrix]) -> tuple[Matrix, Matrix]:
    cluster, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for centroids in history:
        cluster, distance, _ = assign(x, centroids, cluster)
    return cluster, distance


def _assigned(batches: Iterator[pa.RecordBatch], history: list[Matrix], dimensions: int) -> Iterator[tuple[pa.Array, Matrix, Matrix, Matrix]]:
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            part = b.slice(at, BLOCK)
            rows, x = integers(part.column("v"), dimensions)
            yield (part.column("id").take(pa.array(rows)), x, *_replayed(x, history))


def _seeds(vectors: DataFrame, clusters: int, dimensions: int, seed: int) -> list[Matrix]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first few of every batch: the first few of all are among them."""
        for b in batches:
            rows, x = integers(b.column("v"), dimensions)
            ids = ["" if i is None else str(i) for i in b.column("id").take(pa.array(rows)).to_pylist()]
            found = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in zip(ids, x.tolist(), strict=True))[:clusters]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.string()), pa.array([v for _, v in found], pa.list_(pa.int64()))], ["h", "v"])

    first = vectors.mapInArrow(run, "h string, v array<long>").orderBy("h", "v").limit(clusters)
    return np.array([r["v"] for r in first.collect()], np.int64).reshape(-1, dimensions)


def _means(vectors: DataFrame, history: list[Matrix], dimensions: int) -> Matrix:
    """The centroids that follow the last of history."""
    clusters = len(history[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((clusters, dimensions), object), np.zeros(clusters, np.int64)
        for _, x, cluster, _ in _assigned(batches, history, dimensions):
            for c in np.unique(cluster):
                of = x[cluster == c]
                sums[c] += of.sum(0)
                counts[c] += len(of)
        c, i = (a.ravel() for a in np.indices(sums.shape))
        full = counts[c] > 0
        made = [pa.array(c[full], pa.int32()), pa.array(i[full], pa.int32()), pa.array([int(s) for s in sums.ravel()[full]], pa.int64()), pa.array(counts[c][full])]
        yield pa.RecordBatch.from_arrays(made, ["c", "i", "s", "n"])

    added = vectors.mapInArrow(run, "c int, i int, s long, n long").groupBy("c", "i").agg(F.sum(F.col("s").cast("decimal(20,0)")).alias("s"), F.sum("n").alias("n"))
    after = history[-1].copy()
    for r in added.collect():  # clusters x dimensions rows
        after[r["c"], r["i"]] = int(r["s"]) // r["n"]
    return after


def cluster(
    df: DataFrame, id: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, seed: int = SEED
) -> tuple[DataFrame, Matrix]:
    """id, cluster and squared distance of each vector that is kept, and the final centroids."""
    vectors = df.select(F.col(id).cast("bigint").alias("id"), F.col(vector).alias("v"))
    history = [_seeds(vectors, clusters, dimensions, seed)]
    if len(history[0]):
        for _ in range(rounds):
            history.append(_means(vectors, history, dimensions))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, c, d in _assigned(batches, history if len(history[0]) else [], dimensions):
            yield pa.RecordBatch.from_arrays([ids, pa.array(c, pa.int32()), pa.array(d, pa.int64())], [id, "cluster", "distance"])

    return vectors.mapInArrow(run, f"{id} long, cluster int, distance long"), history[-1]


def report(df: DataFrame) -> DataFrame:
    """Each vector's cluster, with inertias and the digest of its centroid."""
    found, centroids = cluster(df)
    each = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("own")).collect()  # a row a cluster
    own = {r["cluster"]: int(r["own"]) for r in each}
    rows = [(c, own.get(c, 0), sum(own.values()), hashlib.sha256(",".join(map(str, m)).encode()).hexdigest()) for c, m in enumerate(centroids.tolist())]
    facts = df.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
