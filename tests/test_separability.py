"""Measures of separability against dense arrays."""

import random

import numpy as np
import pytest

from pairlab.operators import separability as sp
from pairlab.plans import features


def dense(x, own):
    u, s = x[own], x[~own]
    if not len(s):
        return None, None, None, None
    lo, hi = x.min(), x.max()
    hist = 0.0
    if hi - lo >= 1e-8:
        bins = lambda v: np.bincount(np.minimum(np.floor((v - lo) / (hi - lo) * 20), 19).astype(int), minlength=20) / len(v)
        hist = 1 - np.minimum(bins(u), bins(s)).sum()
    at = np.unique(x)
    ks = max(abs((u <= v).mean() - (s <= v).mean()) for v in at)
    auc = ((u[:, None] > s).mean() + (u[:, None] == s).mean() / 2)
    return hist, abs(u.mean() - s.mean()), ks, auc


@pytest.mark.parametrize("seed", range(3))
def test_labels_against_the_rest(spark, seed):
    rng = random.Random(seed)
    rows, sizes, want = [], [], {}
    for layer in (1, 2):
        labels = ["a"] * 30 + ["b"] * 7 + ["c"] * rng.choice([1, 20]) if layer == 1 else ["only"] * 5
        sizes += [(layer, name, labels.count(name)) for name in sorted(set(labels))]
        own = np.array(labels)
        for f in range(5):
            x = np.array([rng.choice([0.0, 0.0, round(rng.gauss(0, 1), 1), 1.5]) for _ in labels])
            if f == 1:
                x = np.where(own == "b", 0.0, x)  # silent there
            if f == 2:
                x = np.abs(x)
            if f == 3:
                x = np.where(own == "a", 1.0, 1.0 + 1e-10)  # everywhere, within no range
            rows += [(layer, name, f, float(v)) for name, v in zip(labels, x) if v]
            if x.any():
                want |= {(layer, name, f): dense(x, own == name) for name in set(labels)}
    entries = spark.createDataFrame(rows, "layer int, label string, feature_id long, value double")
    counted = spark.createDataFrame(sizes, "layer int, label string, n long")
    got = {(r.layer, r.label, r.feature_id): (r.hist_dist, r.delta_mu, r.ks_stat, r.auc) for r in sp.separability(entries, counted, ["layer"]).collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        assert got[k] == pytest.approx(w, abs=1e-12), k
    for m in sp.MEASURES:  # each by itself, too
        one = sp.separability(entries, counted, ["layer"], measures=(m,)).collect()
        assert {(r.layer, r.label, r.feature_id): r[m] for r in one} == {k: pytest.approx(v[sp.MEASURES.index(m)], abs=1e-12) for k, v in want.items()}


def test_the_table_is_read_twice_at_most(spark):
    """Once for the entries and once for the sizes of labels, in the plan that ran; nothing is joined row by row."""
    df = sp.rank_features(features.measured(spark, "/root/testdata/sf0.001", "hist_dist", "delta_mu", "ks_stat"), ["category"])
    ran = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    final = ran.toString().split("== Initial Plan ==")[0]
    assert 1 <= final.count("Scan parquet") <= 2
    assert "CartesianProduct" not in final and final.count("NestedLoop") <= 1  # that with one row of label sizes


def psi(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))


def by_neighbours(x, own, k=3):
    """Point by point: the k-th nearest of the same side, and all that are nearer."""
    used, terms = [i for i in range(len(x)) if (own == own[i]).sum() > 1], []
    for i in used:
        same = (own == own[i]).sum()
        kk = min(k, same - 1)
        d = np.sort(np.abs(x[own == own[i]] - x[i]))[kk]
        m = (np.abs(x - x[i]) < d).sum() if d > 0 else (x == x[i]).sum()
        terms.append((psi(kk), psi(same), psi(m)))
    a, b, c = np.mean(terms, axis=0)
    return max(0.0, psi(len(used)) + a - b - c)


@pytest.mark.parametrize("seed", range(3))
def test_information_by_neighbours(spark, seed):
    rng = random.Random(seed)
    labels = np.array(["a"] * 25 + ["b"] * 14 + ["c"] * 2 + ["d"])
    rows, want = [], {}
    for f in range(5):
        kind = [lambda: rng.choice([0.0, 0.0, rng.random()]), lambda: float(rng.randrange(-2, 3)), rng.random, lambda: rng.choice([0.0, 1.0]), lambda: rng.gauss(0, 1)][f]
        x = np.array([kind() + (2.0 if f == 4 and name == "b" else 0.0) for name in labels])
        rows += [(name, f, float(v)) for name, v in zip(labels, x) if v]
        want |= {(name, f): by_neighbours(x, labels == name) for name in "abcd"}
    entries = spark.createDataFrame(rows, "label string, feature_id long, value double")
    sizes = spark.createDataFrame([(n, int((labels == n).sum())) for n in "abcd"], "label string, n long")
    got = {(r.label, r.feature_id): r.mi for r in sp.neighbour_information(entries, sizes, []).collect()}
    assert got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}
    assert got["b", 4] > 0.2


def test_digamma(spark):
    got = spark.range(1, 60).select("id", sp.digamma(sp.F.col("id")).alias("d")).collect()
    assert all(abs(r.d - psi(r.id)) < 1e-12 for r in got)
