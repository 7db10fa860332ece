"""Operator 11 against plain k-means on Python integers."""

import hashlib
import math
import random

import numpy as np

from recentlake.llm import hadamard_clusters as H
from recentlake.llm import queries as Q


def plain(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [max(-H.LARGEST, min(H.LARGEST, x)) for x in v]) for i, v in kept]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for j, g in groups.items():
            centroids[j] = [sum(x) // len(g) for x in zip(*g)]
    last = [(i, *nearest(v)) for i, v in kept]
    of = {}
    for _, d, j in last:
        of[j] = of.get(j, 0) + d
    return [(i, j, d, of[j], sum(of.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, d, j in last]


def vectors(n, seed, spread=0.3):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0.2 * (i % 5), spread) for _ in range(64)]) for i in range(n)]


def run(spark, path, rows):
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, v int")
    table.write.parquet(f"{path}/embeddings.parquet")
    return sorted((tuple(r) for r in Q.op11_hadamard_clusters(spark, str(path)).collect()), key=repr)


def test_search_equals_all_distances():
    rng = np.random.default_rng(1)
    for _ in range(200):
        m = int(rng.choice([1, 2, 5, 60, H.LARGEST]))
        v, c = (rng.integers(-m, m + 1, (int(rng.integers(1, size)), 64)) for size in (50, 17))
        if rng.random() < 0.4:
            c[-1], v[0] = c[0], c[0]
        d = ((v[:, None] - c[None]) ** 2).sum(2)
        which, least, used = H.nearest(v, c)
        assert (which == d.argmin(1)).all() and (least == d.min(1)).all()
        assert used <= len(v) * len(c) * 64 + len(v) * 64


def test_coarse_levels_leave_out_centroids():
    rng = np.random.default_rng(2)
    c = rng.integers(-200, 200, (16, 64)).cumsum(1) // 4
    v = c[rng.integers(0, 16, 2000)] + rng.integers(-5, 6, (2000, 64))
    assert H.nearest(v, c)[2] < 0.5 * 2000 * 16 * 64


def test_walsh_matrix_is_orthogonal_and_coarse_to_fine():
    w = H.walsh_matrix(64)
    assert (w @ w.T == 64 * np.eye(64)).all()
    assert [(r[1:] != r[:-1]).sum() for r in w] == list(range(64))


def test_query_against_plain_k_means(spark, tmp_path):
    rows = vectors(300, 3)
    rows += [(7, rows[7][1]), (8, rows[9][1]), (None, rows[3][1]), (None, [0.0] * 64)]  # repeated, tied and null ids
    rows += [(500, None), (501, []), (502, [1.0] * 63), (503, [1.0] * 65), (504, [None] + [1.0] * 63),
             (505, [math.nan] + [1.0] * 63), (506, [math.inf] + [1.0] * 63)]
    assert run(spark, tmp_path, rows) == sorted(plain(rows), key=repr)


def test_equal_vectors_empty_clusters_and_very_large_components(spark, tmp_path):
    rows = [(i, [0.5 * (i % 3)] * 64) for i in range(60)] + [(100, [1e30] * 64), (101, [-1e30] + [0.0] * 63)]
    assert run(spark, tmp_path, rows) == sorted(plain(rows), key=repr)


def test_few_vectors_and_empty_table(spark, tmp_path):
    rows = vectors(5, 4)
    assert run(spark, tmp_path / "few", rows) == sorted(plain(rows), key=repr)
    assert run(spark, tmp_path / "none", []) == []
    assert run(spark, tmp_path / "unusable", [(1, None)]) == []
