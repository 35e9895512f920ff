import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlab.llm import neighbours


def product(u, v):
    total = 0.0
    for a, b in zip(u, v, strict=True):
        total += a * b
    return total


def brute(rows, asks, k):
    usable = [(n, i, v) for n, (i, v) in enumerate(rows) if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    out = []
    for n, i, v in usable:
        if asks(i):
            near = sorted((-product(v, w), j) for m, j, w in usable if m != n and len(w) == len(v))[:k]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(near, 1)]
    return sorted(out)


def vectors(rng, n, d):
    some = [[rng.choice([-1, 1]) * rng.random() for _ in range(d)] for _ in range(n)]
    # Copies, multiples and coarse values make ties.
    some += [list(rng.choice(some)) for _ in range(n)]
    some += [[float(rng.randrange(-1, 2)) for _ in range(d)] for _ in range(n)]
    return [(i, v) for i, v in enumerate(rng.sample(some, len(some)))]


@pytest.mark.parametrize("seed", range(3))
def test_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    rows = vectors(rng, 60, rng.choice([1, 3, 16]))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, F.col("vec_id") % 5 == 0, 7, query_rows=11, block_rows=40)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 5 == 0, 7)


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, 2.0]), (-20, [3.0, -1.0]), (None, [9.0, 9.0]), (2, None), (3, []), (4, [0.0, 0.0])]
    rows += [(5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (40, [1.0, 2.0, 3.0]), (41, [1.0, 0.0, 0.0]), (60, [5.0]), (8, [-1.0, -2.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, row int, v string")
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0, 3)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 20 == 0, 3)
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    assert neighbours.nearest(df, F.lit(False)).collect() == []
    # Products beyond the largest number are infinite, and those that are no numbers come last.
    large = [(0, [1e200, -1e200]), (1, [1e200, 1e200]), (2, [1e200, 0.0]), (3, [1.0, 1.0])]
    found = neighbours.nearest(spark.createDataFrame(large, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    assert [(r.vec_id, r.score) for r in found] == [(2, inf), (3, 0.0), (1, -inf)]


def test_bounds_rule_pairs_out():
    """Few pairs are computed twice, and none of the nearest is missed, in wide vectors too."""
    rng = np.random.default_rng(1)
    for d in (64, 1500):
        q, c = rng.normal(size=(40, d)), rng.normal(size=(3000, d)) * rng.lognormal(size=(3000, 1))
        seen = []
        exact = neighbours.inner_products
        neighbours.inner_products = lambda a, i, b, j: seen.append(len(i)) or exact(a, i, b, j)
        try:
            parts = list(neighbours.tile_pairs(q, c, np.full(40, -1), np.arange(3000), 20))
        finally:
            neighbours.inner_products = exact
        assert sum(seen) < 0.05 * 40 * 3000
        got = {(int(i), int(j)) for p in parts for i, j in zip(p[0], p[1], strict=True)}
        order = np.argsort(-(q @ c.T), axis=1)[:, :20]
        assert got == {(i, int(j)) for i in range(40) for j in order[i]}
