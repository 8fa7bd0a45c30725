"""Clustering against brute force in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from sheaf.llm.clustering import Nearest, choose_pivots, cluster_vectors, lengths, squares


def brute(rows, k, rounds, scale, width, seed="1"):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, v) for i, v in kept if all(abs(x) < 2**52 for x in v)]
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in order[:k]]
    if not centroids:
        return []

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), c) for c, m in enumerate(centroids))

    for _ in range(rounds):
        mine = [[] for _ in centroids]
        for _, v in kept:
            mine[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(x) for x in zip(*m)] if m else c for m, c in zip(mine, centroids)]
    found = [(i, *nearest(v)) for i, v in kept]
    total = sum(d for _, d, _ in found)
    fits = lambda n: n if n < 2**63 else None
    return sorted(
        ((i, c, fits(d), fits(sum(e for _, e, b in found if b == c)), fits(total), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, d, c in found),
        key=str)


def check(spark, rows, k=4, rounds=3, scale=64, width=3):
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, id string")
    got = cluster_vectors(table, k, rounds, scale, width)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    found = sorted((tuple(r) for r in got.collect()), key=str)
    assert found == brute(rows, k, rounds, scale, width)
    return found


def some(n, width=3, seed=1, ids=None):
    rng = random.Random(seed)
    middles = [[rng.uniform(-2, 2) for _ in range(width)] for _ in range(5)]
    return [(ids[i] if ids else i, [x + rng.gauss(0, 0.1) for x in rng.choice(middles)]) for i in range(n)]


def test_against_brute_force(spark):
    check(spark, some(300) + [(900, [0.1, 0.2]), (901, None), (902, [0.1, None, 0.2]), (903, [0.1, float("nan"), 1.0]), (904, [float("inf"), 0.0, 0.0]), (905, [])])


def test_ties_repeats_and_null_ids(spark):
    rows = [(i % 7, [float(i % 3), 0.0, 0.0]) for i in range(60)] + [(None, [0.5, 0.0, 0.0])] * 2
    check(spark, rows)
    check(spark, [(i, [0.0, 0.0, 0.0]) for i in range(9)])


def test_few_and_none(spark):
    check(spark, some(2))
    check(spark, [])
    check(spark, [(None, [1.0, 1.0, 1.0])])


def test_large_components(spark):
    rng = random.Random(5)
    rows = some(30) + [(100 + i, [rng.uniform(-1, 1) * 10.0**e for _ in range(3)]) for i, e in enumerate([5, 7, 9, 12, 13, 13, 14, 30, 300])]
    found = check(spark, rows)
    assert any(r[2] is not None and r[2] > 2**53 for r in found) or any(r[2] is None for r in found)


def test_one_round_and_empty_clusters(spark):
    rows = [(i, [float(10 * (i % 2)), 0.0, 0.0]) for i in range(40)]
    check(spark, rows, k=6, rounds=1)
    check(spark, rows, k=6, rounds=0)


@pytest.mark.parametrize("width", [2, 64])
def test_bounds_hold_and_prune(width):
    rng = np.random.default_rng(7)
    middles = rng.integers(-500, 500, (16, width))
    rows = (middles[rng.integers(0, 16, 2000)] + rng.integers(-20, 20, (2000, width))).astype(np.int64)
    pivots = choose_pivots(rows[:64])
    centroids = rows[rng.choice(2000, 16, replace=False)]
    nearest = Nearest(centroids, pivots)
    to_pivots = lengths(rows, pivots)
    exact = np.stack([squares(rows, c) for c in centroids], axis=1)
    assert (nearest.bounds(to_pivots) <= exact).all()
    cluster, distance = nearest(rows, to_pivots)
    assert (cluster == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    assert nearest.checked < 0.7 * exact.size


def test_bounds_with_points_on_pivots():
    rows = np.array([[0, 0], [3, 4], [3, 4], [6, 8], [-3, -4]], np.int64)
    pivots = choose_pivots(rows)
    assert len(pivots) == 4
    nearest = Nearest(rows, pivots)
    cluster, distance = nearest(rows, lengths(rows, pivots))
    assert cluster.tolist() == [0, 1, 1, 3, 4] and not distance.any()
