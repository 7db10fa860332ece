"""Centroid clustering (operator 11): exact k-means on integer vectors with
Walsh-Hadamard progressive search.

Vectors of ``DIM`` components become the integers floor(64 * x).  ``H``, the
Walsh-Hadamard matrix with its rows in order of sign changes, is orthogonal up
to a factor: the squared distance of H v and H c is DIM times that of v and c,
and all of it is integer.  To find the nearest of k centroids, the squared
differences of the coefficients are summed coarse to fine in ``LEVELS``:

* a partial sum never exceeds the whole one;
* after the first level the centroid of the smallest partial sum is finished
  (all coefficients); its whole sum bounds the nearest one's from above;
* after each level, centroids whose partial sum is strictly above that bound
  are out: they are strictly farther.  Equal ones stay, so ties are decided
  by the smaller number, on whole sums;
* those that remain are finished to the last of the 64 coefficients.

A round is one pass over the vectors: each task sums its vectors by nearest
centroid, and k rows a task are shuffled.  The k centroids (k * DIM integers)
are all that the driver holds and what is sent to the tasks.  The integer
vectors are written once to the shared folder and read again each round.

Special cases: vectors that are null, of another size, or with a null or
non-finite component are left out.  Components are held at +-``LARGEST``, as
a squared distance would not fit a long beyond.  Fewer than k vectors give as
many centroids.  Equal vectors give equal results; a repeated id keeps all its
rows, and may start several centroids; a null id hashes as the text ``null``.
Starts of equal hashes are ordered by their components.  An empty table gives
an empty result.  Other columns of the input are not read.  An inertia that
does not fit a long is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recentlake.llm.common import discard, saved

DIM = 64
CENTROIDS = 16
ROUNDS = 3
SCALE = 64
SEED = 1
LARGEST = 1 << 24
#: Coefficients known after each level.
LEVELS = (4, 8, 16, 32, 64)
#: Vectors searched at once.
BLOCK = 4096


def walsh_matrix(n: int) -> np.ndarray:
    """The Walsh-Hadamard matrix of size ``n``, a power of two, rows by their
    number of sign changes: from coarse to fine."""
    h = np.ones((1, 1), np.int64)
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return h[np.argsort((h[:, 1:] != h[:, :-1]).sum(1), kind="stable")]


_WALSH = walsh_matrix(DIM)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid of each integer vector (ties: the smaller
    number), its squared distance, and how many coefficients were summed."""
    n, k = len(vectors), len(centroids)
    # float64 products of these integers are exact: below 2^24 * 64 = 2^30
    v = (vectors.astype(np.float64) @ _WALSH.T.astype(np.float64)).astype(np.int64)
    c = (centroids.astype(np.float64) @ _WALSH.T.astype(np.float64)).astype(np.int64)
    first = LEVELS[0]
    partial = np.zeros((n, k), np.int64)
    for j in range(first):
        partial += (v[:, j, None] - c[None, :, j]) ** 2
    row = np.arange(n)
    # the most promising one is finished at once and bounds the others
    guess = partial.argmin(1)
    bound = partial[row, guess] + ((v[:, first:] - c[guess, first:]) ** 2).sum(1)
    used = n * k * first + n * (DIM - first)
    alive = partial <= bound[:, None]
    alive[row, guess] = False
    at, who = np.nonzero(alive)
    total = partial[at, who]
    for lo, hi in zip(LEVELS, LEVELS[1:]):
        if not len(at):
            break
        total = total + ((v[at, lo:hi] - c[who, lo:hi]) ** 2).sum(1)
        used += len(at) * (hi - lo)
        left = total <= bound[at]
        at, who, total = at[left], who[left], total[left]
    best, least = guess, bound
    if len(at):
        whole = np.full((n, k), np.iinfo(np.int64).max, np.int64)
        whole[at, who] = total
        whole[row, guess] = bound
        best = whole.argmin(1)  # the first, so the smaller number, of equal ones
        least = whole[row, best]
    return best.astype(np.int32), least // DIM, used


# -- DataFrames ----------------------------------------------------------------


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id`` and ``v``, floor(64 * x) of the components, of usable vectors."""
    x = F.col(f"`{vector_col}`")
    usable = (F.size(x) == DIM) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    held = F.transform(x, lambda e: F.floor(F.greatest(F.least(e.cast("double"), F.lit(LARGEST / SCALE)), F.lit(-LARGEST / SCALE)) * SCALE).cast("int"))
    return vectors.where(F.coalesce(usable, F.lit(False))).select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), held.alias("v"))


def start_hash(seed: int = SEED) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)


def first_centroids(ints: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors of the smallest hashes (a bounded top-k)."""
    rows = ints.orderBy(start_hash(seed), "v").limit(k).select("v").collect()
    return np.array([r.v for r in rows], np.int64).reshape(len(rows), DIM)


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a list column, one a row."""
    return np.asarray(column.flatten(), np.int64).reshape(len(column), DIM)


def _searched(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    parts = [nearest(vectors[lo:lo + BLOCK], centroids)[:2] for lo in range(0, len(vectors), BLOCK)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def moved(ints: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: exact floors of their vectors' means."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centroids), DIM + 1), np.int64)
        for batch in batches:
            if batch.num_rows:
                vectors = _matrix(batch.column(0))
                which, _ = _searched(vectors, centroids)
                order = np.argsort(which, kind="stable")
                present, first = np.unique(which[order], return_index=True)
                total[present, :DIM] += np.add.reduceat(vectors[order], first)
                total[:, DIM] += np.bincount(which, minlength=len(centroids))
        present = np.flatnonzero(total[:, DIM])
        if len(present):
            yield pa.RecordBatch.from_arrays(
                [pa.array(present.astype(np.int32)), *(pa.array(total[present, j]) for j in range(DIM + 1))],
                names=["cluster", *(f"s{j}" for j in range(DIM)), "n"])

    columns = [*(f"s{j}" for j in range(DIM)), "n"]
    parts = ints.select("v").mapInArrow(sums, "cluster int, " + ", ".join(f"{c} bigint" for c in columns))
    # decimals: sums over any number of tasks stay exact
    whole = parts.groupBy("cluster").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in columns)).collect()
    out = centroids.copy()
    for row in whole:
        out[row["cluster"]] = [int(row[c]) // int(row["n"]) for c in columns[:-1]]
    return out


def assigned(ints: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vec_id``, its nearest ``cluster`` and squared ``distance``."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                which, distance = _searched(_matrix(batch.column(1)), centroids)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(which), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return ints.select("vec_id", "v").mapInArrow(search, "vec_id bigint, cluster int, distance bigint")


def clustered(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED,
              id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per usable vector: ``vec_id, cluster, distance, cluster_inertia,
    inertia, centroid`` (its cluster's final components)."""
    spark, paths = vectors.sparkSession, []
    ints = saved(integer_vectors(vectors, id_col, vector_col), "integer-vectors", paths)
    centroids = first_centroids(ints, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(ints, centroids)
    final = saved(assigned(ints, centroids), "assigned")
    discard(spark, paths)
    # k rows at most, held by the driver like the centroids
    sums = final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()
    whole = {r["cluster"]: int(r["d"]) for r in sums}
    table = spark.createDataFrame(
        [(j, _long(d), _long(sum(whole.values())), [int(x) for x in centroids[j]]) for j, d in sorted(whole.items())],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    return final.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def _long(n: int) -> int | None:
    return n if n < 1 << 63 else None


def centroid_digest(centroid: str = "centroid") -> Column:
    """Lowercase hex SHA-256 of the components as decimals joined by commas."""
    return F.sha2(F.array_join(F.transform(F.col(centroid), lambda x: x.cast("string")), ","), 256)
