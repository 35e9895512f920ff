"""Percentiles against numpy, with so few rows held that ranges must be split."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlab.operators.quantiles import coarse_place, exact_percentiles

WANTED = {"p0": 0.0, "p025": 0.025, "p50": 0.5, "p90": 0.9, "p1": 1.0}


def sample(kind, rng):
    n = rng.randrange(1, 400)
    return {
        "even": lambda: [rng.random() for _ in range(n)],
        "signed": lambda: [rng.gauss(0, 1) * 10 ** rng.randrange(-200, 200) for _ in range(n)],
        "close": lambda: [1e15 + rng.randrange(40) / 8 for _ in range(n)],
        "tied": lambda: [rng.choice([0.0, -0.0, 2.5]) for _ in range(n)] + [7.0] * n,
        "one": lambda: [3.0],
        "tiny": lambda: [rng.choice([5e-324, -5e-324, 1.7e308, -1.7e308, 0.0, 1.0]) for _ in range(n)],
        "ends": lambda: [rng.choice([math.inf, -math.inf, 1.0, 2.0]) for _ in range(n)],
    }[kind]()


@pytest.mark.parametrize("held", [1, 7, 10_000])
def test_against_numpy(spark, held):
    rng = random.Random(held)
    groups = {k: sample(k, rng) for k in ("even", "signed", "close", "tied", "one", "tiny")}
    rows = [(k, x) for k, v in groups.items() for x in v] + [("even", None), ("none", None), (None, 4.0), (None, 8.0)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r for r in exact_percentiles(df, ["g"], "x", WANTED, held).collect()}
    assert set(got) == {*groups, None} and got[None].p50 == 6.0
    for g, values in groups.items():
        with np.errstate(over="ignore"):
            want = np.quantile(values, list(WANTED.values()))
        for name, w in zip(WANTED, want, strict=True):
            assert got[g][name] == pytest.approx(w, rel=1e-12, abs=1e-300), (g, name)


def test_whole_table_and_odd_values(spark):
    df = spark.createDataFrame([(x,) for x in (math.inf, -math.inf, 1.0, 1.0, math.nan)], "x double")
    out = exact_percentiles(df, [], "x", {"low": 0.0, "mid": 0.5, "next": 0.75, "top": 1.0}, 1).collect()
    assert len(out) == 1 and (out[0].low, out[0].mid, out[0].next) == (-math.inf, 1.0, math.inf) and math.isnan(out[0].top)
    assert exact_percentiles(df.limit(0), [], "x", {"m": 0.5}).collect() == []
    clash = df.select(F.col("x").alias("v"), F.lit(1).alias("n"), F.lit(2).alias("lo"))
    assert exact_percentiles(clash.where("NOT isnan(v)"), ["n", "lo"], "v", {"rank": 0.5}).collect()[0].rank == 1.0


def test_places_never_fall(spark):
    rng = random.Random(2)
    values = sorted([rng.gauss(0, 1) * 10.0 ** rng.randrange(-320, 308) for _ in range(3000)] + [0.0, 5e-324, -5e-324, math.inf, -math.inf, 1.0, math.nextafter(1.0, 2)])
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double")
    places = [r[0] for r in df.orderBy("i").select(coarse_place(F.col("x"))).collect()]
    assert places == sorted(places)


def test_a_large_group_takes_few_passes(spark, monkeypatch):
    from pairlab.operators import quantiles

    passes = []
    cut = quantiles.cut
    monkeypatch.setattr(quantiles, "cut", lambda df, name: passes.append(name) or cut(df, name))
    n = 1_000_003
    df = spark.range(n).select((F.col("id") * 7919 % n).cast("double").alias("x"))
    out = exact_percentiles(df, [], "x", {"a": 0.025, "b": 0.5, "c": 0.975}, 2000).first()
    assert (out.a, out.b, out.c) == ((n - 1) * 0.025, (n - 1) / 2, (n - 1) * 0.975)
    assert len(passes) <= 2
