"""Centroid clustering: exact against plain integers where float32 can't tell, and on odd rows."""

import hashlib
import math

import numpy as np
import pytest

from archspark.llm import clusters

SCHEMA = "vec_id long, embedding array<double>, cluster int, packed string, distance string"


def plain(rows, k=8, rounds=10):
    kept = [(i, [math.floor(int(x) * 1024 if abs(x) >= 2**53 else x * 1024) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest()))
    c = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        groups = [[v for (_, v), o in zip(kept, own) if o == j] for j in range(len(c))]
        c = [[sum(x) // len(g) for x in zip(*g)] if g else old for g, old in zip(groups, c)]
    found = [(i, *near(v)) for i, v in kept]
    sums = [sum(d for _, d, j in found if j == n) for n in range(len(c))]
    return [(i, j, d, sums[j], sum(sums), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in found]


def check(spark, rows):
    given = spark.createDataFrame([(i, v, 1, "p", "d") for i, v in rows], SCHEMA).repartition(3)
    fit = lambda x: x if x < 2**63 else None
    want = [(i, j, fit(d), fit(s), fit(t), h) for i, j, d, s, t, h in plain(rows)]
    assert sorted(map(str, map(tuple, clusters.clusters(given).collect()))) == sorted(map(str, want))


RNG = np.random.default_rng(5)


def test_close_and_equal_centroids(spark):
    base = RNG.normal(0, 300, 64)
    close = [(i, (base + RNG.integers(-3, 4, 64) / 1024).tolist()) for i in range(400)]
    check(spark, close + [(i, v) for i, (_, v) in enumerate(close[:30])])


def test_odd_rows(spark):
    some = [(i, RNG.normal(0, 0.2, 64).tolist()) for i in range(60)]
    odd = [(1, None), (2, []), (3, [0.5] * 63), (4, [0.5] * 65), (5, [0.5] * 63 + [None]), (6, [math.nan] * 64), (7, [1.0] * 63 + [-math.inf]), (None, [0.25] * 64), (8, [0.0] * 64), (8, [0.0] * 64)]
    check(spark, some + odd)
    check(spark, odd)
    assert clusters.clusters(spark.createDataFrame([], SCHEMA)).collect() == []
    assert clusters.clusters(spark.createDataFrame([(1, [1.0], 1, "p", "d")], SCHEMA)).collect() == []


@pytest.mark.parametrize("size", [2.0**17, 1e6, 1e20, 3e38, 1e300])
def test_components_of_any_size(spark, size):
    check(spark, [(i, RNG.normal(0, 1, 64).tolist()) for i in range(20)] + [(100 + i, (RNG.normal(0, 1, 64) * size).tolist()) for i in range(6)])


def test_intervals_hold_the_exact_value():
    v = RNG.integers(-clusters.NARROW + 1, clusters.NARROW, (500, 64))
    c = v[:8].copy()
    c[4] = c[0]
    near = clusters.Nearest(c.tolist())
    close = c[RNG.integers(0, 8, 500)] + RNG.integers(-2, 3, (500, 64))
    for x in (v, np.clip(close, 1 - clusters.NARROW, clusters.NARROW - 1), np.zeros((3, 64), np.int64)):
        want = np.array([near.plain(r)[0] for r in x.tolist()])
        open_ = near.screened(x)
        assert open_[np.arange(len(x)), want].all() and (near.labels(x) == want).all()
    assert near.screened(close).sum() < 8 * len(close) / 3
