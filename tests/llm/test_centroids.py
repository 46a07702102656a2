import hashlib
import random

import numpy as np
import pytest

from millrace.llm import centroids


def brute(vectors, k=40, rounds=5, seed=2):
    """Lloyd's rounds in plain integers over (id, components) of kept vectors."""
    x = [[int(np.floor(min(max(256 * float(c), -(2.0**27)), 2.0**27))) for c in v] for _, v in vectors]
    order = sorted(range(len(x)), key=lambda i: (vectors[i][0] is None, hashlib.sha256(f"{seed}:{vectors[i][0]}".encode()).hexdigest(), x[i]))
    c = [list(x[i]) for i in order[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        own = [nearest(v)[1] for v in x]
        for j in range(len(c)):
            mine = [v for v, o in zip(x, own) if o == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine)]
    last = [nearest(v) for v in x]
    of = lambda j: sum(d for d, o in last if o == j)
    return sorted(((i, j, d, of(j), sum(d for d, _ in last), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(vectors, last)), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("kind", ["spread", "grid", "copies"])
def test_equals_plain_rounds(spark, kind):
    r = random.Random(kind)
    draw = {"spread": lambda: r.gauss(0, 0.2), "grid": lambda: r.randint(0, 1) / 256, "copies": lambda: 0.5}[kind]
    vectors = [(i, [draw() for _ in range(8)]) for i in range(300)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    vectors = [(i, [np.float32(c) for c in v]) for i, v in vectors]
    assert got(centroids.clustered(df, k=25, dimensions=8)) == brute(vectors, k=25)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.1] * 4), (1, [0.1] * 4), (None, [0.2] * 4), (2, None), (3, [1.0] * 3), (4, [1.0, None, 1.0, 1.0]), (5, [nan] * 4), (6, [inf, 0.0, 0.0, 0.0]), (7, [1e300, -1e300, 0.0, -0.001])]
    df = spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id long, embedding array<double>, cluster string, v double")
    kept = [rows[i] for i in (0, 1, 2, 8)]
    assert got(centroids.clustered(df, k=3, dimensions=4)) == brute(kept, k=3)
    assert got(centroids.clustered(df, k=40, dimensions=4)) == brute(kept, k=40)
    assert centroids.clustered(df.filter("vec_id > 100"), dimensions=4).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert got(centroids.clustered(df.filter("vec_id > 100"), dimensions=4)) == []


def test_bounds_spare_distances():
    """After the first round most rows are settled without a scan, and scans see part of the centroids."""
    g = np.random.default_rng(0)
    middle = g.integers(-2000, 2000, (64, 8))
    x = middle[g.integers(0, 64, 4000)] + g.integers(-30, 30, (4000, 8))
    at = x[:64].copy()
    own, upper, lower = np.full(4000, -1), np.zeros(4000), np.zeros(4000)
    balls = centroids.Balls(at)
    scans = []
    for _ in range(6):
        scans.append(balls.assign(x, own, upper, lower))
        d = centroids.squared(x, balls.at)
        assert (own == d.argmin(axis=1)).all()
        assert (upper**2 >= d[np.arange(4000), own] * (1 - 1e-9)).all()
        new = np.array([x[own == j].sum(0) // (own == j).sum() if (own == j).any() else balls.at[j] for j in range(64)])
        centroids.moved(upper, lower, own, np.sqrt(centroids.own_squared(new, balls.at)))
        balls = centroids.Balls(new)
    assert scans[0] >= 4000 * 64 and max(scans[2:]) < 4000 * 24


def test_distances_are_exact_beyond_doubles():
    x = np.array([[centroids.LIMIT, -centroids.LIMIT, 1]] * 2)
    c = np.array([[-centroids.LIMIT, centroids.LIMIT, 0], [0, 0, 0]])
    assert centroids.squared(x, c).tolist() == [[2 * (1 << 56) + 1, 2 * (1 << 54) + 1]] * 2
