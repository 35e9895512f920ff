import hashlib

import numpy as np

from pairlab.operators import features as fx


def by_hand(unsafe, safe, places, replicates, share, seed):
    """AUCs of every feature over resamples of the unsafe arm, drawn by hash; places are the rows in order of drawing."""
    n = len(unsafe)
    out = []
    for r in range(replicates):
        draws = [int(hashlib.md5(f"{seed}|{r}|{d}".encode()).hexdigest()[:15], 16) % n for d in range(max(2, int(n * share)))]
        u = unsafe[[places[i] for i in draws]]
        out.append([((u[:, None, i] > safe[None, :, i]).mean() + (u[:, None, i] == safe[None, :, i]).mean() / 2) for i in range(unsafe.shape[1])])
    return np.array(out)


def ranks(x):
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


def test_group_stability_against_dense_arms(spark):
    rng = np.random.default_rng(3)
    x = np.where(rng.random((240, 3)) < [0.1, 0.05, 0.2], rng.integers(1, 4, (240, 3)), 0).astype(float)
    unsafe = np.arange(240) < 60
    x[unsafe, 0] = np.where(rng.random(60) < 0.5, 2.0, 0.0)
    assert (x.sum(axis=1) == 0).sum() > 100  # most samples are silent, and count
    rows = [(1, "unsafe" if unsafe[i] else "safe", int(i), int(f), float(x[i, f])) for i, f in zip(*np.nonzero(x))]
    rows += [(3, "unsafe", i, 0, 1.0) for i in range(5)]  # five active unsafe samples against silent safe ones
    long = spark.createDataFrame(rows, "category long, arm string, sample_id long, feature_id long, value double")
    sizes = spark.createDataFrame([(1, 60, 180), (2, 5, 7), (3, 5, 9), (4, 1, 9)], "category long, n_unsafe long, n_safe long")
    rows = [("a", 1, [0, 1, 2], 0.5, 0.1, 0.7, None), ("none", 2, [0, 1], 0.5, 0.1, 0.9, False), ("sure", 3, [0], None, 0.1, 0.9, False), ("one", 4, [0], 0.5, 0.1, 0.9, False)]
    groups = spark.createDataFrame(rows, "group_id string, category long, feature_ids array<long>, repair_rate double, corruption_rate double, auc double, exempt boolean")
    got = {r.group_id: r for r in fx.group_stability(long, sizes, ["category"], groups, replicates=30).collect()}
    active = sorted((i for i in range(60) if x[i].any()), key=lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest())
    aucs = by_hand(x[unsafe], x[~unsafe], active + [i for i in range(60) if not x[i].any()], 30, 0.8, 42)
    pairs = [(i, j) for i in range(20) for j in range(i)]
    top = [set(sorted(range(3), key=lambda k: (-round(r[k], 12), -k))[:2]) for r in aucs]
    corr = [np.corrcoef(ranks(aucs[i].round(12)), ranks(aucs[j].round(12)))[0, 1] for i, j in pairs]
    assert abs(got["a"].auc_mean - aucs.mean()) < 1e-9
    assert abs(got["a"].jaccard - np.mean([len(top[i] & top[j]) / len(top[i] | top[j]) for i, j in pairs])) < 1e-9
    assert abs(got["a"].rank_corr - np.nanmean(corr)) < 1e-9
    assert got["none"].auc_mean == 0.5 and got["none"].jaccard == 1.0 and got["none"].rank_corr == 0.5
    assert got["sure"].auc_mean == 1.0 and not got["sure"].deployable  # no repair rate
    assert got["none"].deployable and got["a"].deployable == (got["a"].jaccard >= 0.5 and got["a"].rank_corr >= 0.5)
    assert (got["one"].jaccard, got["one"].rank_corr, got["one"].auc_mean) == (0.5, 0.5, 0.5)


def test_deployable_needs_every_gate(spark):
    """Stable groups that fail one gate each: repair must be above 0, corruption at most 0.2, AUC at least 0.6 unless exempt."""
    long = spark.createDataFrame([(1, "unsafe", i, 0, 1.0) for i in range(5)], "category long, arm string, sample_id long, feature_id long, value double")
    sizes = spark.createDataFrame([(1, 5, 9)], "category long, n_unsafe long, n_safe long")
    cases = {"ok": (0.1, 0.2, 0.6, False), "repair": (0.0, 0.2, 0.6, False), "corrupt": (0.1, 0.21, 0.6, False), "auc": (0.1, 0.2, 0.59, False), "exempt": (0.1, 0.2, 0.1, True), "unknown": (0.1, None, 0.6, False)}
    groups = spark.createDataFrame([(k, 1, [0], *v) for k, v in cases.items()], "group_id string, category long, feature_ids array<long>, repair_rate double, corruption_rate double, auc double, exempt boolean")
    got = {r.group_id: r.deployable for r in fx.group_stability(long, sizes, ["category"], groups, replicates=5).collect()}
    assert got == {"ok": True, "repair": False, "corrupt": False, "auc": False, "exempt": True, "unknown": False}


def test_states_need_no_dense_row(spark):
    """131,072 features, a prompt without entries, held-out and unknown categories, negative values in a group."""
    rows = [(1, 19, 131_071, 2.0), (1, 19, 5, -1.5), (1, 16, 7, -3.0), (1, 16, 9, 4.0), (2, 16, 7, -3.0), (2, 16, 8, -1.0)]
    entries = spark.createDataFrame(rows, "id int, layer int, feature_id long, value double")
    prompts = spark.createDataFrame([(1, "b"), (2, "h"), (3, None)], "id int, c string")
    groups = [(16, [7, 8]), (16, [7, 9, 11]), (19, [5])]
    got = {r.id: r for r in fx.build_states(prompts, entries, "id", "c", ["a", "b"], ["h"], groups, 19, size=40, seed=3).collect()}
    bit = lambda f, j: int(hashlib.md5(f"3|{f}|0".encode()).hexdigest()[8 * (j // 32) : 8 * (j // 32) + 8], 16) >> (j % 32) & 1
    z = np.array([2.0 * (1 - 2 * bit(131_071, j)) - 1.5 * (1 - 2 * bit(5, j)) for j in range(40)])
    assert np.allclose(got[1].state[:40], z / np.linalg.norm(z), atol=1e-12) and got[1].known
    assert got[1].state[40:] == [0, 1, 0, 0, 0.0, -1.5, 0.0, 4.0, 1 / 3, 1 / 3, -1.5, -1.5, 0.0]
    assert got[2].state[:40] == [0.0] * 40 and not got[2].known and got[2].state[40:44] == [0, 0, 1, 0]
    assert got[2].state[44:47] == [-1.0, -2.0, 0.0]  # all of the group is active, and below zero
    assert got[3].state == [0.0] * 43 + [1.0] + [0.0] * 9 and not got[3].known


def test_fidelity_merges(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(2, 1, (30, 4))
    y, f = x + rng.normal(0, 0.3, (30, 4)), np.where(rng.random((30, 9)) < 0.2, 1.0, 0.0)
    rows = [("k", a.tolist(), b.tolist(), c.tolist()) for a, b, c in zip(x, y, f)] + [("k", None, [1.0] * 4, [0.0])]
    df = spark.createDataFrame(rows, "k string, x array<double>, y array<double>, f array<double>").repartition(3)
    parts = [fx.fidelity_state(df.where(c), ["k"], "x", "y", "f") for c in ("x[0] < 2", "x[0] >= 2", "x IS NULL")]
    out = fx.fidelity_metrics(fx.merge_fidelity(*parts, keys=["k"]), ["k"]).collect()
    whole = fx.fidelity_metrics(fx.fidelity_state(df, ["k"], "x", "y", "f"), ["k"]).first()
    sse = ((x - y) ** 2).sum()
    tokens, dims = ((x - x.mean(1, keepdims=True)) ** 2).sum(), ((x - x.mean(0)) ** 2).sum()
    want = [30, 120, sse / 120, np.sqrt(sse / (x * x).sum()), sse / tokens, 1 - sse / tokens, sse / dims, 1 - sse / dims, f.sum() / 30]
    assert len(out) == 1 and np.allclose(out[0][1:], want) and np.allclose(whole[1:], want)
