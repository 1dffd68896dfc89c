"""Centroid clustering by delta Lloyd: only what changed is worked out again.

State: a table with each vector, its owner and the squared distance to it, and the
global sums and counts of the clusters.  In each round

1. a vector whose owner kept its centroid compares its stored distance with the centroids
   that changed, and no others; one whose owner moved compares all,
2. vectors that change their owner are transfers: minus the vector for the old
   owner, plus it for the new one; tasks add their transfers up, Spark adds the tasks'
   sums, and the global sums take them in,
3. centroids with a changed sum are worked out again.

Everything is in integers (components are ``floor(scale * x)``), so sums don't depend on
an order and a task that is run again gives the same.  Only centroids, sums and
counts are on the driver, ``k`` rows each, and a table with the new owners is written
in the shared folder in every round.

Definitions: vectors with another number of components, or with a null or non-finite one, are
left out, as are those with an integer beyond ``+-2**27``, whose squared distances could
leave a long.  Start: the vectors with the smallest hashes of their ids, ties by
components (a null id counts as an empty string); with fewer vectors than
``k`` there are fewer centroids.  Repeated rows count again.  Sums of distances that
leave a long are null.  An empty table gives an empty result.  Only the two named
columns are read; others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaria.llm.scratch import Scratch

#: Largest component of which squared distances of 64 fit a long.
BOUND = 1 << 27
#: Up to this, products and their sums are exact in doubles, so that matrix products can be used.
EXACT = 1 << 22
STATE = "id long, v array<int>, before int, cluster int, distance long"


def integer_vectors(vectors: DataFrame, size: int, scale: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, v: the vectors that are kept, in integers."""
    v = F.transform(F.col(vec_col).cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))))
    good = F.coalesce(F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) * scale < BOUND)), F.lit(False))
    kept = vectors.filter((F.size(vec_col) == size) & good)
    return kept.select(F.col(id_col).cast("long").alias("id"), v.cast("array<int>").alias("v"))


def first_centroids(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The vectors whose ids have the k smallest hashes."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(key.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in rows], dtype=np.int64)


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows, as longs."""
    if not len(x) or not len(c):
        return np.zeros((len(x), len(c)), dtype=np.int64)
    if max(np.abs(x).max(), np.abs(c).max()) < EXACT:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], axis=1)


def reassign(x: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New owners and distances; changed tells which centroids are not what the stored distances were taken to."""
    owner, distance = owner.copy(), distance.copy()
    moved = (owner < 0) | changed[owner]
    if moved.any():
        d = squared_distances(x[moved], centroids)
        best = d.argmin(1)  # of equal ones the first, so the smaller number
        owner[moved], distance[moved] = best, d[np.arange(len(best)), best]
    rest, open_ = ~moved, np.flatnonzero(changed)
    if rest.any() and len(open_):
        d = squared_distances(x[rest], centroids[open_])
        k = d.argmin(1)
        least, number = d[np.arange(len(k)), k], open_[k]
        better = (least < distance[rest]) | ((least == distance[rest]) & (number < owner[rest]))
        at = np.flatnonzero(rest)[better]
        owner[at], distance[at] = number[better], least[better]
    return owner, distance


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.int64)


def _assign(state: DataFrame, centroids: np.ndarray, changed: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = centroids.shape[1]
        for b in batches:
            if not b.num_rows:
                continue
            before = b["cluster"].to_numpy(zero_copy_only=False)
            owner, distance = reassign(_matrix(b["v"], size), before, b["distance"].to_numpy(zero_copy_only=False), centroids, changed)
            yield pa.RecordBatch.from_arrays(
                [b["id"], b["v"], b["cluster"], pa.array(owner, pa.int32()), pa.array(distance, pa.int64())], ["id", "v", "before", "cluster", "distance"]
            )

    return state.mapInArrow(run, STATE)


def _transfers(state: DataFrame, k: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Signed changes of the clusters' counts and sums by vectors that changed their owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(k, dtype=np.int64), np.zeros((k, size), dtype=np.int64)
        for b in batches:
            if b.num_rows:
                x, old, new = _matrix(b["v"], size), b["before"].to_numpy(), b["cluster"].to_numpy()
                np.add.at(n, new, 1)
                np.add.at(s, new, x)
                had = old >= 0
                np.subtract.at(n, old[had], 1)
                np.subtract.at(s, old[had], x[had])
        touched = np.flatnonzero((n != 0) | (s != 0).any(1))
        rows, part = np.repeat(touched, size + 1), np.tile(np.arange(-1, size), len(touched))
        amount = np.concatenate([n[touched, None], s[touched]], axis=1).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(part, pa.int32()), pa.array(amount, pa.int64())], ["cluster", "part", "amount"])

    moved = state.filter("before <> cluster").select("v", "before", "cluster")
    total = moved.mapInArrow(run, "cluster int, part int, amount long").groupBy("cluster", "part").agg(F.sum("amount").alias("amount"))
    n, s = np.zeros(k, dtype=np.int64), np.zeros((k, size), dtype=np.int64)
    for r in total.collect():  # k clusters of size + 1 numbers
        if r.part < 0:
            n[r.cluster] = r.amount
        else:
            s[r.cluster, r.part] = r.amount
    return n, s


def cluster(
    vectors: DataFrame, k: int, rounds: int, size: int = 64, scale: int = 256, salt: str = "2", id_col: str = "vec_id", vec_col: str = "embedding"
) -> tuple[DataFrame, np.ndarray]:
    """(id, v, cluster, distance of every kept vector, the final centroids)."""
    scratch = Scratch(vectors.sparkSession, "delta_lloyd")
    ints = integer_vectors(vectors, size, scale, id_col, vec_col)
    none = F.lit(-1).cast("int")
    state = scratch.table(ints.select("id", "v", none.alias("before"), none.alias("cluster"), F.lit(-1).cast("long").alias("distance")))
    centroids = first_centroids(state, k, salt).reshape(-1, size)
    k = len(centroids)
    n, sums = np.zeros(k, dtype=np.int64), np.zeros((k, size), dtype=np.int64)
    changed = np.ones(k, dtype=bool)
    for turn in range(rounds + 1 if k else 0):
        if not changed.any():  # nothing to compare in any later round
            break
        last, state = state, scratch.table(_assign(state, centroids, changed))
        scratch.drop(last)
        if turn == rounds:
            break
        more, moved = _transfers(state, k, size)
        n, sums = n + more, sums + moved
        fresh = np.where(n[:, None] > 0, sums // np.maximum(n, 1)[:, None], centroids)  # floor division
        changed, centroids = (fresh != centroids).any(1), fresh
    return state.select("id", "v", "cluster", "distance"), centroids


def cluster_report(vectors: DataFrame, k: int, rounds: int, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    spark = vectors.sparkSession
    state, centroids = cluster(vectors, k, rounds, **options)
    sums = {r.cluster: r.s for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    fits = lambda s: int(s) if s is not None and abs(s) < 1 << 63 else None
    whole = fits(sum(sums.values())) if sums else None
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    table = [(i, fits(sums.get(i)), whole, s) for i, s in enumerate(sha)]
    said = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    rows = state.select(F.col("id").alias("vec_id"), "cluster", "distance").join(F.broadcast(said), "cluster")  # k rows
    return rows.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
