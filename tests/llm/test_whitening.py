import random
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest

from pairlab.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def brute(rows, most=32):
    """By vec_id and place: integers, deviations, and numpy's components of the exact covariance."""
    x = [[int(np.floor(64.0 * c)) + 1_000_000 for c in v] for v in rows]
    n, d = len(x), len(x[0])
    s = [sum(v[j] for v in x) for j in range(d)]
    deviation = [sum((n * v[j] - s[j]) ** 2 for j in range(d)) for v in x]
    centred = np.array([[float(Fraction(n * v[j] - s[j], n)) for j in range(d)] for v in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)
    return n, deviation, centred, values[order][:most], vectors[:, order][:, :most], values.sum()


def check(found, ids, rows, most=32):
    n, deviation, centred, values, vectors, trace = brute(rows, most)
    rank = int((values > 1e-9 * trace).sum())
    got = {}
    for r in found:
        got.setdefault(r.component, {}).setdefault(r.vec_id, []).append(r)
    assert sorted(got) == list(range(1, rank + 1))
    error = {r.identity_error for r in found}
    assert len(error) == 1 and error.pop() < 1e-9
    for k in range(1, rank + 1):
        assert sum(map(len, got[k].values())) == len(ids)
        want = centred @ vectors[:, k - 1] / np.sqrt(values[k - 1])
        distinct = min([abs(values[k - 1] - v) for j, v in enumerate(values) if j != k - 1], default=1) > 1e-6 * values[0]
        have = []
        for i, row, dev in zip(ids, rows, deviation, strict=True):
            r = next(r for r in got[k][i] if r.deviation == dev)
            assert r.n == n and abs(r.explained / (values[k - 1] / trace) - 1) < 1e-9
            have.append(r.whitened)
        if distinct:
            sign = np.sign(np.dot(have, want))
            assert np.abs(sign * np.array(have) - want).max() < 1e-7
    return got


def test_query(spark):
    df = pd.read_parquet(f"{SF}/embeddings.parquet")
    found = queries.op12_embedding_whitening(spark, SF).collect()
    check(found, df["vec_id"].tolist(), df["embedding"].tolist())


@pytest.mark.parametrize("seed", range(3))
def test_exact_polynomial(spark, seed):
    rng = random.Random(seed)
    d = rng.randrange(1, 9)
    rows = np.array([[rng.randrange(-(10**7), 10**7) for _ in range(d)] for _ in range(rng.randrange(1, 12))], object)
    m = rows.T @ rows
    got = whitening.symmetric_functions(spark.range(1), m)
    poly = [Fraction(1)]  # Faddeev and LeVerrier
    power = np.zeros((d, d), object)
    for k in range(1, d + 1):
        power = m @ (power + np.eye(d, dtype=object) * poly[-1])
        poly.append(-sum(power[i, i] for i in range(d)) / Fraction(k))
    assert got == [int((-1) ** k * c) for k, c in enumerate(poly)]


def test_roots():
    values = [7, 7, 7, 10**12, 3, 10**12 + 1, 1, 0, 0]
    poly = [1]
    for v in values:
        poly = [a - v * b for a, b in zip([*poly, 0], [0, *poly], strict=True)]
    roots = whitening.RealRoots([(-1) ** k * c for k, c in enumerate(poly)])
    assert roots.rank == 7
    for k, v in enumerate(sorted(values, reverse=True)[:7], 1):
        y, place, count = roots.root(k)
        assert (v << roots.shift) - 2 <= y <= v << roots.shift
        assert (place, count) == ((k - 3, 3) if v == 7 else (0, 1))


def test_gram_is_exact():
    rng = np.random.default_rng(3)
    for bits in (5, 20, 21, 40, 61):
        rows = rng.integers(-(1 << bits), 1 << bits, (37, 4))
        assert (whitening.exact_gram(rows) == rows.astype(object).T @ rows.astype(object)).all()


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.1, 0.2, 3.0]), (2, [0.4, -0.5, 3.0]), (2, [0.4, -0.5, 3.0]), (None, [0.9, 0.9, 3.0]), (4, [-1.5, 0.25, 3.0])]
    bad = [(5, None), (6, []), (7, [nan, 0.0, 0.0]), (8, [inf, 0.0, 0.0]), (9, [None, 0.0, 0.0]), (10, [1.0, 2.0]), (11, [1e30, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "k", 5) for i, v in good + bad], "vec_id long, embedding array<double>, x string, n int")
    got = whitening.whiten(df, keep=("x", "n"))
    assert got.columns == ["vec_id", "x", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(got.collect(), [i for i, _ in good], [v for _, v in good])
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], "vec_id long, embedding array<float>")
    assert whitening.whiten(same).collect() == []
    assert whitening.whiten(same.limit(1)).collect() == []
    assert whitening.whiten(df.limit(0)).collect() == []
    # Equal variances share a space; large entries stay exact, though deviations may be no longs.
    square = [[a * 2.0**40, b * 2.0**40, c * 2.0**40] for a, b, c in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))]
    far = whitening.whiten(spark.createDataFrame(list(enumerate(square)), "vec_id long, embedding array<double>")).collect()
    assert len(far) == 18 and {r.deviation for r in far} == {None} and far[0].identity_error < 1e-9
    assert all(abs(r.explained - 1 / 3) < 1e-12 for r in far)
