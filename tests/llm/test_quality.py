import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from pairlab.llm import quality


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    inside = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside), failed


def rows(seed):
    rng = random.Random(seed)
    out = []
    for i in range(1200):
        bad = i % 19 == 0
        parts = [("#|" * rng.randrange(1, 4) if bad and rng.random() < 0.4 else rng.choice(["the", "été", "of", "a\xa0b", "w%d" % rng.randrange(500)])) + rng.choice([" ", "  ", "\n", "\t", "\r\n", "\x0b", " \n\n"]) for _ in range(rng.randrange(0, 40) if i % 400 == 1 else rng.randrange(60, 120))]
        text = "".join(parts) + ("".join(parts[:20]) * (rng.randrange(0, 3) if i % 10 == 2 else 0))
        out.append((i, text, int(not bad)))
    return out


def test_statistics(spark):
    data = [(d, t) for d, t, _ in rows(1)] + [(None, "x y"), (2007, None), (2008, ""), (2003, "a " * 5000), (2003, "a " * 5000), (9, "\n\n\n"), (10, "same line\nsame line\n" * 3)]
    df = spark.createDataFrame([(d, t, 1.5) for d, t in data], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(d, q) for d, _, q in rows(1)] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = quality.judge_quality(df, labels).collect()
    assert sorted(((r.doc_id, *r[1:7]) for r in got), key=str) == sorted(((d, *brute(t)) for d, t in data), key=str)
    assert not any(r.kept and r.base_failed for r in got)
    bad = {d for d, t, q in rows(1) if not q and not brute(t)[5] and "#" in t}
    assert sum(not r.kept for r in got if r.doc_id in bad) > 0.5 * len(bad)
    good = [r for r in got if r.doc_id is not None and r.doc_id < 1200 and r.doc_id % 19 and not r.base_failed]
    assert sum(r.kept for r in good) >= 0.97 * len(good)


def test_without_labels(spark):
    df = spark.createDataFrame([(1, "a b c " * 3), (2, " ".join("w%d" % i for i in range(30)))], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.doc_id: r.kept for r in quality.judge_quality(df, labels).collect()} == {1: False, 2: True}
    assert quality.judge_quality(df.limit(0), labels).count() == 0


def test_catches_bad_documents_that_were_not_labelled(spark):
    """Labels of one half of the tables' labelled documents; the verdicts of the other half count."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    seen = F.pmod(F.xxhash64(F.col("doc_id") + 1), F.lit(2)) == 0
    judged = quality.judge_quality(docs, labels.where(seen)).join(labels.where(~seen), "doc_id").where("NOT base_failed")
    counts = {r.quality: r for r in judged.groupBy("quality").agg(F.count("*").alias("n"), F.count_if(~F.col("kept")).alias("gone")).collect()}
    assert counts[0].gone >= 0.6 * counts[0].n > 30
    assert counts[1].gone <= 0.015 * counts[1].n


def test_few_or_one_sided_labels(spark):
    data = rows(3)
    df = spark.createDataFrame([(d, t) for d, t, _ in data], "doc_id long, text string")
    for chosen in ([1], [0, 1], [1, 1, 1]):
        labels = spark.createDataFrame([(d, q) for (d, _, _), q in zip(data[2:], chosen)], "doc_id long, quality int")
        got = quality.judge_quality(df, labels).collect()
        assert len(got) == len(data) and not any(r.kept and r.base_failed for r in got)


def test_forest_finds_outliers():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(900, 2)), rng.normal(loc=6, size=(20, 2))])
    scores = quality.IsolationForest.grow(x, [0, 1]).score(x)
    assert quality.auc(scores, np.arange(920) >= 900) > 0.98
