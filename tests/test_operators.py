"""Hand-made cases: golden values, edge cases and properties that the tables don't show."""

import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from pairlab.functions import text as tx
from pairlab.operators import cost, curate, features, outcomes, quality, rewards, sampling, scan, stats
from pairlab.sources import io
from pairlab.streaming.scan_stream import scan_stream


def test_wilson_and_mcnemar_golden(spark):
    df = spark.createDataFrame([(5, 13, 5, 1), (10, 37, 0, 0), (3, 197, 3, 3), (0, 0, 0, 7)], "k int, n int, b int, c int")
    low, high = stats.wilson("k", "n")
    rows = df.select(low.alias("low"), high.alias("high"), stats.mcnemar_exact("b", "c").alias("p")).collect()
    assert [round(x, 6) for x in rows[0]] == [0.177097, 0.644771, 0.21875]
    assert [round(rows[1].low, 6), round(rows[1].high, 6), rows[1].p] == [0.153975, 0.429782, 1.0]
    assert [round(rows[2].low, 6), round(rows[2].high, 6), rows[2].p] == [0.005192, 0.043809, 1.0]
    assert rows[3].low is None and abs(rows[3].p - 2 / 128) < 1e-12


def test_confusion_golden(spark):
    rows = [("x", True, True)] * 20 + [("x", True, False)] * 4 + [("x", False, True)] * 5 + [("x", False, False)] * 21
    out = scan.confusion(spark.createDataFrame(rows, "c string, s boolean, h boolean"), F.col("s"), F.col("h"), ["c"]).where("c = 'x'").first()
    assert (out.tp, out.fp, out.fn, out.tn, out.fpr) == (20, 4, 5, 21, 0.16)


def test_bootstrap_brackets_the_point(spark):
    rng = random.Random(3)
    rows = [(i, rng.random() < 0.6, rng.random() < 0.4) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, a boolean, b boolean")
    out = stats.paired_bootstrap(df, F.col("a").cast("int"), F.col("b").cast("int"), 2000).first()
    point = sum(a - b for _, a, b in rows) / 300
    assert out.low < point < out.high and out.n == 2000
    assert abs((out.high - out.low) - 2 * 1.96 * math.sqrt(0.48 / 300)) < 0.04
    again = stats.paired_bootstrap(df.repartition(7), F.col("a").cast("int"), F.col("b").cast("int"), 2000).first()
    assert again == out
    ratio = stats.cluster_bootstrap(df.withColumn("g", F.col("id") % 30), ["g"], F.col("a").cast("int"), F.lit(1), 500).first()
    assert ratio.low < sum(a for _, a, _ in rows) / 300 < ratio.high


def capped_by_hand(sizes, target):
    """One seat each, largest remainders of what is left, then overflow to those with room until none is left."""
    quota = {k: 1 for k in sizes}
    left, free = target - len(sizes), dict(sizes)
    first = True
    while left:
        weight = sum(free.values())
        room = {k: math.inf if first else sizes[k] - quota[k] for k in free}
        add = {k: min(left * n // weight, room[k]) for k, n in free.items()}
        spare = left - sum(add.values())
        for k in sorted(free, key=lambda k: (-(left * free[k] % weight), k)):
            if spare and add[k] < room[k]:
                add[k], spare = add[k] + 1, spare - 1
        for k, n in add.items():
            quota[k] = min(sizes[k], quota[k] + n)
        left, first = target - sum(quota.values()), False
        free = {k: n for k, n in sizes.items() if quota[k] < n}
    return quota


def test_hamilton(spark):
    rng = random.Random(4)
    cases = [({0: 50, 1: 11}, 35)]
    for _ in range(6):
        sizes = {i: rng.choice([1, 1, 2, rng.randrange(1, 30)]) for i in range(rng.randrange(2, 9))}
        cases.append((sizes, rng.randrange(len(sizes), sum(sizes.values()) + 1)))
    for sizes, target in cases:
        df = spark.createDataFrame(list(sizes.items()), "k int, n long")
        assert sum(r.quota for r in sampling.hamilton(df, "k", "n", target).collect()) == target
        assert {r.k: r.quota for r in sampling.hamilton_capped(df, "k", "n", target).collect()} == capped_by_hand(sizes, target)
    assert capped_by_hand(*cases[0]) == {0: 28, 1: 7}
    with pytest.raises(ValueError):
        sampling.hamilton_capped(df, "k", "n", 0)


def test_caps_and_balance(spark):
    rows = [("a", i, False) for i in range(8)] + [("a", 100 + i, True) for i in range(9)] + [("b", 200 + i, True) for i in range(3)]
    df = spark.createDataFrame(rows, "k string, id int, aug boolean")
    out = sampling.cap_augmented(df, ["k"], "aug", "id", 0.2, 1).collect()
    assert sum(r.k == "a" and r.aug for r in out) == 2 and sum(r.k == "a" for r in out) == 10
    assert sum(r.k == "b" for r in out) == 3  # no raw rows: all stay
    cut = sampling.balance_groups(df, ["k"], "aug", "id", 2.0, 1).collect()
    assert sum(r.k == "a" for r in cut) == 9 and sum(r.k == "a" and not r.aug for r in cut) == 8  # 17 of 3: relaxed to 3 times
    free = sampling.balance_groups(df, ["k"], "aug", "id", 2.0, 1, treated=F.col("k") != "b").collect()
    assert len(free) == 20
    close = sampling.balance_groups(df.where("k = 'b' OR id < 7"), ["k"], "aug", "id", 2.0, 1).collect()
    assert sum(r.k == "a" for r in close) == 6
    ranked = sampling.group_rank(df, ["k"], "id", 1, first=F.col("aug")).collect()
    assert sorted(r["__r"] for r in ranked if r.k == "a") == list(range(1, 18)) and max(r["__r"] for r in ranked if r.k == "a" and r.aug) == 9
    controls = sampling.sample_controls(df, ["k"], F.col("id") == 0, "id", 5, 1).collect()
    assert sum(r.k == "a" for r in controls) == 6 and not any(r.k == "b" for r in controls)


def test_splits_are_exact_and_disjoint(spark):
    df = spark.range(1003).select("id", (F.col("id") % 211).alias("unit"), (F.col("id") % 10 == 0).alias("held"))
    rows = sampling.split_rows(df, "id", 0.37, 5).collect()
    assert sum(r.split == "dev" for r in rows) == int(1003 * 0.37)
    units = {}
    for r in sampling.split_by_unit(df, "unit", (0.6, 0.2), F.col("held"), 5).where("NOT held").collect():
        units.setdefault(r.unit, set()).add(r.split)
    assert all(len(s) == 1 for s in units.values()) and sum(s == {"train"} for s in units.values()) == int(len(units) * 0.6)
    ranked = sampling.global_rank(sampling.with_hash(df, "id", 1), "__h").select("__h", "rank").orderBy("rank").collect()
    assert [r.rank for r in ranked] == list(range(1, 1004)) and [r["__h"] for r in ranked] == sorted(r["__h"] for r in ranked)


@pytest.mark.parametrize("held", [3, 40, 100_000])
def test_tree_ranks(spark, held):
    """Ranks are those of one sort, however deep the buckets go, with a hot group and null keys."""
    rows = [("hot" if i % 5 else None if i % 2 else f"k{i % 3}", i, i % 7 == 0) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, id int, f boolean")
    key = lambda i: hashlib.md5(f"9|{i}".encode()).hexdigest()
    want = {}
    for first in (False, True):
        for group in {r[0] for r in rows}:
            own = sorted((r for r in rows if r[0] == group), key=lambda r: (first and not r[2], key(r[1])))
            want |= {(first, r[1]): n for n, r in enumerate(own, 1)}
    for first, column in ((False, None), (True, F.col("f"))):
        got = sampling.group_rank(df, ["k"], "id", 9, column, held)
        assert got.columns == ["k", "id", "f", "__r"]
        assert {(first, r.id): r["__r"] for r in got.collect()} == {k: v for k, v in want.items() if k[0] == first}
    whole = sampling.global_rank(sampling.with_hash(df, "id", 9), "__h", held).collect()
    assert {r.id: r["rank"] for r in whole} == {r[1]: n for n, r in enumerate(sorted(rows, key=lambda r: key(r[1])), 1)}


def test_no_task_numbers_a_group(spark):
    """A group of 20,000 rows is numbered in buckets of some hundred."""
    df = sampling.with_hash(spark.range(20_000).withColumn("k", F.lit("hot")), "id", 1)
    leaves = sampling.tree_totals(df, ["k"], ["__h", "id"], held=500).withColumn("b", F.substring("__h", 1, 2))
    assert leaves.groupBy("b").count().agg(F.max("count")).first()[0] < 500
    assert leaves.agg(F.max("__r"), F.count_distinct("__r")).first()[:] == (20_000, 20_000)


def test_draws_follow_the_patterns(spark, monkeypatch):
    """Sums over drawn units have the mean and spread of draws with replacement, and each replicate draws all units once."""
    rows = [(float(i % 3), 1.0) for i in range(1000)]
    df = spark.createDataFrame(rows, "a double, b double")
    table = stats.patterns(df, [], [F.col("a"), F.col("b")])
    got = stats.resampled_sums(table, 2, 3000, 42).collect()
    assert len(got) == 3000 and all(r.sums[1] == r.n == 1000 for r in got)
    mean, spread = 999 / 1000, math.sqrt((1000 * 2 / 3) + 0)
    values = [r.sums[0] / 1000 for r in got]
    assert abs(sum(values) / 3000 - mean) < 4 * spread / 1000 / math.sqrt(3000)
    sd = math.sqrt(sum((v - mean) ** 2 for v in values) / 2999) * 1000
    assert abs(sd / spread - 1) < 0.06
    monkeypatch.setattr(stats, "FEW_VALUES", 0)
    held = stats.resampled_sums(table, 2, 3000, 42, held=1).collect()
    assert sorted(map(str, held)) == sorted(map(str, got))


def test_text_edges(spark):
    rows = [(None,), ("",), ("  \n",), ("\n".join(map(str, range(40))),), ("\n".join(map(str, range(41))),), ("a\r\nb",)]
    out = spark.createDataFrame(rows, "t string").select(tx.emptiness("t"), tx.nonblank_lines("t"), F.size(F.split(tx.truncate_lines("t"), "\n"))).collect()
    assert [r[0] for r in out] == ["empty", "empty", "whitespace_only", "non_empty", "non_empty", "non_empty"]
    assert [r[1] for r in out] == [0, 0, 0, 40, 41, 2] and [r[2] for r in out][3:5] == [40, 41]
    names = spark.createDataFrame([("cpp",), (" JS ",), (None,), ("",), ("go",), ("visual BASIC",)], "l string").select(tx.normalize_language("l")).collect()
    assert [r[0] for r in names] == ["C++", "JavaScript", "Unknown", "Unknown", "Go", "Visual basic"]
    code = spark.createDataFrame([("```py\nx = 1\n```\nmid\n```\ny\n```",), ("no",), ("```py\nx",), (None,)], "c string")
    assert [tuple(r) for r in code.select(tx.extract_fenced("c"), tx.extract_fenced("c", "all")).collect()] == [("x = 1", "x = 1\ny"), ("no", "no"), ("```py\nx", "x"), ("", "")]
    ok = spark.createDataFrame([("x = 1",), ("x =",), (None,), ("  ",)], "c string").select(tx.py_syntax_ok("c")).collect()
    assert [r[0] for r in ok] == [True, False, False, False]


def test_patch_classes(spark):
    rows = [
        ("See CVE-2020-1234, refactor", False, "security_patch"),
        ("overflow", True, "security_patch"),
        ("refactor docs", True, "undecidable"),
        ("refactor docs", False, "non_security_patch"),
        ("buffer overflow in refactor", False, "security_patch"),  # buffer, overflow against refactor
        ("fix typo in comment", False, "non_security_patch"),  # fix against typo, comment
        ("fix typo", False, "undecidable"),
        ("hello", True, "undecidable"),
        (None, True, "security_patch"),
        ("", False, "undecidable"),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "m string, l boolean")
    assert [r[0] for r in df.select(tx.classify_patch("m", F.col("l"))).collect()] == [r[2] for r in rows]


def test_failures_and_content(spark):
    rows = [("HOOK_EXCEPTION", "NONE"), ("WHITESPACE_ONLY", "NONE"), ("SUCCESS", "USED"), ("MALFORMED_GENERATION", "USED"), (None, None), ("GENERATION_EXCEPTION", "NONE")]
    out = tx.failure_counts(spark.createDataFrame(rows, "s string, f string"), [], F.col("s"), F.col("f")).first()
    assert (out.n, out.n_hook, out.n_generation, out.n_malformed, out.n_other, out.n_fallback) == (6, 1, 1, 1, 1, 3)
    texts = [("a <|x|>",), ("x\n <|User|> :\ny",), ("assistant",), ("user: hello",), ("  def f():",), ("\n\ndef f():",), (" \n",), (None,)]
    got = spark.createDataFrame(texts, "t string").select(*(c.alias(k) for k, c in tx.content_flags("t", ["def "]).items())).collect()
    assert [r.has_role_marker for r in got] == [True, True, True, False, False, False, False, False]
    assert [r.starts_with_token for r in got] == [False, False, False, False, False, True, False, False]
    assert [r.is_blank for r in got] == [False] * 6 + [True, True]
    found = tx.secret_scan(spark.createDataFrame([(1, "key=abc x@y"), (2, None), (3, "x@y")], "id int, t string"), "id", "t", [("key", "key="), ("mail", "@y")])
    assert sorted((r.id, r.name) for r in found.collect()) == [(1, "key"), (1, "mail"), (3, "mail")]


def test_raw_rates_golden(spark):
    """25 of 60 repaired but 48 records vulnerable: corrected 0.416667, raw 0.20; and 36 of 60 with 27: 0.60 and 0.55."""
    rows = []
    for m, repaired, vulnerable in (("a", 25, 48), ("b", 36, 27)):
        rows += [(m, "c", True, False, i >= repaired, False, True) for i in range(60)]
        new = vulnerable - (60 - repaired)
        rows += [(m, "c", False, False, i < new, False, True) for i in range(40)]
    df = spark.createDataFrame(rows, "m string, category string, b0_vulnerable boolean, b0_skipped boolean, is_vulnerable boolean, skipped boolean, valid boolean")
    out = {r.m: r for r in outcomes.paired_metrics(df, ["m"]).collect()}
    assert (out["a"].n_repaired, round(out["a"].corr_vrr, 6), round(out["a"].raw_vrr, 6), out["a"].n_raw_vulnerable) == (25, 0.416667, 0.2, 48)
    assert (out["b"].n_repaired, round(out["b"].corr_vrr, 6), round(out["b"].raw_vrr, 6), out["b"].n_corrected_vulnerable) == (36, 0.6, 0.55, 24)
    four = [("m", "c" if i else "other", True, False, False, False, i != 0) for i in range(4)] + [("m", "c", False, False, True, False, True)] * 3
    first = outcomes.method_metrics(spark.createDataFrame(four, df.schema), ["m"], ["c"]).first()
    assert (first.vrr, first.corrected_vrr, first.n_empty) == (0.25, 0.25, 0)
    every = outcomes.method_metrics(spark.createDataFrame(four, df.schema), ["m"]).first()
    assert (every.vrr, every.corrected_vrr) == (0.25, 0.0)


def test_rewards(spark):
    rows = [(1, 0, True, 0, True, True, False), (1, 1, False, 2, True, True, False), (1, 2, False, 1, True, True, None), (1, 3, False, 1, False, True, False), (2, 0, True, 0, True, False, False), (2, 1, False, 3, True, False, True)]
    df = spark.createDataFrame(rows, "prompt_id int, action_id int, is_noop boolean, level int, valid boolean, b0_vulnerable boolean, is_vulnerable boolean")
    scored = df.withColumn("reward", rewards.base_reward(F.col("prompt_id") == 1))
    got = {(r.prompt_id, r.action_id): round(r.reward, 6) for r in scored.collect()}
    assert got == {(1, 0): 1.25, (1, 1): 1.15, (1, 2): -1.0, (1, 3): -1.0, (2, 0): 0.0, (2, 1): -1.65}
    examples = {r.prompt_id: r for r in rewards.training_examples(rewards.regret(scored, ["prompt_id"]), F.col("prompt_id") == 1).collect()}
    assert examples[1].label == 0 and round(examples[1].weight, 6) == round(1 + 1.25 - 0.1 + 0.25, 6)
    assert rewards.training_examples(rewards.regret(scored.where("prompt_id = 1").limit(1).withColumn("reward", F.lit(1.0)), ["prompt_id"]), F.lit(True)).first().weight == 1.25
    predictions = spark.createDataFrame([("p", 1, 0), ("p", 2, 1), ("p", 3, 2)], "policy string, prompt_id int, action_id int")
    actions = spark.createDataFrame([(0, True, False, False), (1, False, False, True), (2, False, True, False)], "action_id int, is_noop boolean, masked boolean, is_high boolean")
    out = rewards.policy_metrics(predictions, rewards.regret(scored.select("prompt_id", "action_id", "reward"), ["prompt_id"]), actions, ["policy"]).first()
    assert (round(out.noop_rate, 6), round(out.masked_rate, 6), out.high_rate, out.n_without_outcome, out.rcr) == (0.333333, 0.333333, 0.5, 1, 1.0)


def test_candidate_actions(spark):
    groups = spark.createDataFrame([("g1", "a", 3, 0.2), ("g2", "a", 2, 0.9), ("g3", "b", 3, 0.5), ("g4", "c", 3, 0.1)], "group_id string, category string, high int, repair_rate double")
    acts = rewards.action_table(groups, [("Low", 1), ("Med", 2), ("High", 3)])  # 1-3 g1, 4-6 g2 (6 masked), 7-9 g3, 10-12 g4
    prompts = spark.createDataFrame([(1, "a"), (2, "c"), (3, "zz"), (4, None)], "prompt_id int, category string")
    out = rewards.candidate_actions(prompts, acts, ["c", "a"]).collect()
    got = {p: sorted((r.why, r.action_id) for r in out if r.prompt_id == p) for p in (1, 2, 3, 4)}
    assert got[1] == [("control", 7), ("matched", 4), ("matched", 5), ("noop", 0)]  # the better group only, no fallback
    assert got[2] == [("control", 1), ("matched", 10), ("matched", 12), ("noop", 0)]  # by name of strength: High before Low
    assert got[3] == [("active", 1), ("active", 10), ("control", 7), ("noop", 0)]
    assert got[4] == got[3]  # no category is an unknown one, and has a control
    few = rewards.candidate_actions(prompts.where("prompt_id = 3"), acts, ["c", "a"], most=3).collect()
    assert sorted(r.why for r in few) == ["active", "active", "noop"]


def test_audit_sample(spark):
    rows = [(i, "x" if i < 6 else "y", ["x"] if i % 2 == 0 else [], i % 2 == 0) for i in range(12)]
    df = spark.createDataFrame(rows, "id int, category string, detected array<string>, is_vulnerable boolean")
    out = scan.audit_sample(df, "id", "category", {"x": 2, "y": 9}, 2, 8, 42).collect()
    assert len(out) == len({r.id for r in out}) == 8
    assert sum(r.target == "x" and r.picked_as == "detected" for r in out) == 2
    assert all(r.id < 6 and r.id % 2 for r in out if r.target == "x" and r.picked_as == "not_detected")
    assert all(r.id >= 6 for r in out if r.target == "y") and sum(r.target == "y" for r in out) == 2
    assert all(r.id % 2 for r in out if r.picked_as == "padding") and sum(r.picked_as == "padding" for r in out) == 2


def test_group_type_needs_auc(spark):
    rows = [("c", 1, "c", 0.54, True, 0.5, 0.0), ("c", 2, "c", 0.6, True, 0.9, 0.05)]
    sem = spark.createDataFrame(rows, "validated string, feature_id int, primary_category string, primary_auc double, category_match boolean, repair_rate double, corrupt_rate double").withColumn("assigned_tags", F.array(F.lit("t")))
    got = {r.group_type: list(r.feature_ids) for r in features.build_groups(sem, ["validated"]).collect()}
    assert got == {"A": [2, 1], "B": [2], "C": [2]}


def test_link_commits_without_ids(spark):
    commits = spark.createDataFrame([("a", "m"), ("b", "m"), ("c", "m")], "hash string, msg string")
    fixes = spark.createDataFrame([("a", "v1"), ("a", "v2"), ("a", "v1"), ("b", "v9")], "hash string, vuln_id string")
    classes = spark.createDataFrame([("v1", "c1"), ("v1", "c2"), ("v2", None)], "vuln_id string, category string")
    files = spark.createDataFrame([("a", "C"), ("a", "C"), ("a", "Go"), ("c", None)], "hash string, language string")
    out = curate.link_commits(commits, fixes, classes, files).collect()
    assert len(out) == 8 and sum(r.hash == "a" for r in out) == 6
    assert {(r.vuln_id, r.category, r.language) for r in out if r.hash == "b"} == {("v9", None, None)}


def test_skipped_is_never_safe(spark):
    rows = [(1, True, False, False, False, True), (1, True, False, False, True, True), (1, False, True, False, False, True), (1, False, False, True, False, True), (1, False, False, True, True, True), (1, True, False, False, False, False)]
    df = spark.createDataFrame(rows, "m int, b0_vulnerable boolean, b0_skipped boolean, is_vulnerable boolean, skipped boolean, valid boolean")
    out = outcomes.paired_metrics(df, ["m"]).first()
    assert (out.n_vulnerable, out.n_safe, out.n_repaired, out.n_removed, out.n_corrupted, out.n_valid) == (3, 2, 1, 3, 1, 5)
    one = outcomes.seed_summary(spark.createDataFrame([("a", 0.5)], "k string, x double"), ["k"], ["x"]).first()
    assert one.x_sd is None and one.x_mean == 0.5


def test_holm_and_selection(spark):
    p = spark.createDataFrame([("f", 0.01), ("f", 0.04), ("f", 0.03), ("f", 0.9)], "k string, p double")
    assert [round(r.p_holm, 6) for r in stats.holm(p, "p", ["k"]).orderBy("p").collect()] == [0.04, 0.09, 0.09, 0.9]
    df = spark.createDataFrame([("t", 1, 0.5, 2, True), ("t", 2, 0.5, 1, True), ("t", 3, 0.9, 0, False)], "t string, id int, rate double, bad int, ok boolean")
    best = {r.id: (r.selected, r.losing_field) for r in stats.select_best(df, ["t"], [("rate", False), ("bad", True), ("id", True)], F.col("ok")).collect()}
    assert best == {1: (False, "bad"), 2: (True, None), 3: (False, None)}


def test_scan_rules_keep_the_first(spark):
    rules = [("a", "a1", "xx"), ("a", "a2", "x"), ("b", "b1", "y")]
    df = spark.createDataFrame([(1, "xxy"), (2, "x"), (3, None), (4, "z")], "id int, t string")
    got = {r.id: [tuple(f) for f in r.f] for r in df.select("id", scan.scan_rules("t", rules).alias("f")).collect()}
    assert got == {1: [("a", "a1"), ("b", "b1")], 2: [("a", "a2")], 3: [], 4: []}


def test_stream_scans_once(spark, tmp_path):
    rules = [("a", "a1", "x")]
    arrive = lambda rows: spark.createDataFrame(rows, "id long, t string").write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda own: scan_stream(spark, f"{tmp_path}/in", "id long, t string", f"{tmp_path}/out", f"{tmp_path}/{len(own)}", "id", "t", own).awaitTermination()
    arrive([(1, "x"), (2, "y"), (2, "y")])
    run(rules)
    arrive([(1, "x"), (3, None)])
    run(rules)
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2, 3]
    run([*rules, ("b", "b1", "y")])  # other rules: all are scanned again
    assert spark.read.parquet(f"{tmp_path}/out").count() == 6


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, 'a "quoted", text\nwith lines', "TRUE "), (2, "ü;\\", "no"), (3, "﻿x", "false")]
    df = spark.createDataFrame(rows, "id long, t string, b string")
    io.write_csv(df, f"{tmp_path}/c")
    back = io.read_csv(spark, f"{tmp_path}/c", "id long, t string, b string").select("id", "t", io.text_boolean("b").alias("b")).orderBy("id").collect()
    assert [tuple(r) for r in back] == [(1, rows[0][1], True), (2, rows[1][1], False), (3, rows[2][1], False)]


def test_checks(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, " ")], "id int, secret string")
    assert [tuple(r) for r in quality.forbidden_fields(df, ["id"], ["secret", "none"]).collect()] == [(1, "secret")]
    old = spark.createDataFrame([(1, "x"), (9, "y")], "id int, sha256 string")
    assert {tuple(r) for r in quality.drift(df, old, "id", F.col("secret")).collect()} == {(1, "changed"), (2, "new"), (3, "new"), (9, "missing")}
    assert quality.duplicates(df.unionByName(df.where("id = 1")), ["id"]).collect()[0].n == 2


def test_dominance_is_over_all_prompts(spark):
    """An action tried once and best there doesn't dominate 100 prompts; one that is best for 86 of them does."""
    rows = [(p, 0, True, 0.0) for p in range(100)] + [(p, 1, False, 1.0) for p in range(86)] + [(99, 2, False, 1.0)]
    df = rewards.regret(spark.createDataFrame(rows, "prompt_id int, action_id int, is_noop boolean, reward double"), ["prompt_id"])
    got = {r.action_id: r for r in rewards.action_distribution(df).collect()}
    assert {a: (r.n_best, r.best_share, r.dominant) for a, r in got.items()} == {0: (13, 0.13, False), 1: (86, 0.86, True), 2: (1, 0.01, False)}
    assert (got[0].regret_min, got[0].regret_max, round(got[0].regret_mean, 6)) == (-1.0, 0.0, -0.87) and abs(got[0].regret_sd - math.sqrt(0.87 * 0.13)) < 1e-12
    out = rewards.reward_coverage(df).first()
    assert (out.n_prompts, out.n_with_action, out.coverage, out.covered, out.dominance_warning, out.noop_reward, out.action_reward) == (100, 87, 0.87, False, True, 0.0, 1.0)


def test_split_report(spark):
    """Only derivation categories have a minimum and a ratio, each its own; one without rows fails; a held-out row is no matter."""
    rows = [("a", f"a{i}", "train", i < 10, True) for i in range(30)] + [("b", f"b{i}", "test", i < 7, i > 0) for i in range(12)] + [("held", "h", "test", True, True), ("held", "a1", "test", False, True)]
    df = spark.createDataFrame(rows, "c string, u string, split string, aug boolean, sec boolean")
    report = lambda d: {(r.check, r.category): (r.status, r.observed) for r in quality.split_report(d, "split", "u", "c", ["held"], {"a": 20, "b": 13, "gone": 1}, augmented=F.col("aug"), secure=F.col("sec"), total=40).collect()}
    got = report(df)
    assert got["category_minimum", "a"] == ("PASS", 30.0) and got["category_minimum", "b"] == ("FAIL", 12.0) and got["category_minimum", "gone"] == ("FAIL", 0.0)
    assert ("category_minimum", "held") not in got and got["category_ratio", None] == ("PASS", 2.5)
    assert got["augmented_fraction", "b"] == ("FAIL", 7 / 12) and got["augmented_fraction", "held"] == ("PASS", 0.5)
    assert got["secure_fraction", "b"][0] == "WARN" and got["secure_fraction", "a"] == ("PASS", 1.0)
    assert got["unit_overlap", None] == ("PASS", 0.0) and got["total", None] == ("PASS", 44.0)
    leak = report(df.unionByName(spark.createDataFrame([("held", "b1", "train", False, True)], df.schema)))
    assert leak["heldout_outside_test", None] == ("FAIL", 1.0) and leak["unit_overlap", None] == ("FAIL", 1.0)
    assert report(df.limit(0))["category_minimum", "a"] == ("FAIL", 0.0)


def test_a_drop_at_the_threshold_exceeds_it(spark):
    rows = [(b, c, t, (t < 4) if c == "base" else (t < 4 - k)) for b, k in (("x", 1), ("y", 0)) for c in ("base", "m") for t in range(4)]
    df = spark.createDataFrame(rows, "bench string, condition string, task_id int, passed boolean")
    limits = spark.createDataFrame([("x", 0.25), ("y", 0.25)], "bench string, threshold double")
    got = {r.bench: (r.delta, r.regressed, r.status) for r in stats.utility_deltas(df, ["bench"], "base", limits).collect()}
    assert got == {"x": (-0.25, 1, "DROP_EXCEEDS_THRESHOLD"), "y": (0.0, 0, "WITHIN_THRESHOLD")}


def test_stage_cost_counts_statuses(spark):
    rows = [(1, "draft", 0, 1, 5, 1.0, "COMPLETED"), (1, "repair", 1, None, 0, 0.5, "SKIPPED"), (2, "draft", 0, 1, 5, 1.0, "COMPLETED"), (2, "repair", 1, 2, 7, 2.0, "COMPLETED"), (3, "draft", 0, 1, 1, 1.0, None)]
    df = spark.createDataFrame(rows, "rec int, stage string, pos int, call int, tokens long, seconds double, status string")
    by, bad = cost.stage_cost(df, ["rec"], ["draft", "repair"], "pos")
    got = {r.stage: r for r in by.collect()}
    assert got["draft"].statuses == {"COMPLETED": 2, "NOT_RECORDED": 1} and got["repair"].statuses == {"COMPLETED": 1, "SKIPPED": 1}
    assert got["ALL"].statuses == {"COMPLETED": 3, "NOT_RECORDED": 1, "SKIPPED": 1}
    assert (got["ALL"].n_rows, got["ALL"].calls, got["ALL"].tokens, got["ALL"].seconds, got["ALL"].n_incomplete) == (5, 4, 18, 5.5, 2)
    assert bad.first()[:] == (3, 2)


def test_split_counts(spark):
    df = spark.createDataFrame([("dev", "a")] * 3 + [("dev", "b")] + [("test", "a")], "split string, c string")
    got = {(r.split, r.category): (r.n, r.share) for r in sampling.split_counts(df, "split", "c").collect()}
    assert got == {("dev", "a"): (3, 0.75), ("dev", "b"): (1, 0.25), ("dev", "ALL"): (4, 1.0), ("test", "a"): (1, 1.0), ("test", "ALL"): (1, 1.0)}


def test_canonical_digest(spark, monkeypatch):
    monkeypatch.setattr(tx, "PIECE", 7)
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(20), rng.choice([f'id "{i}"\n', f"é{i}"])) for i in range(300)] + [("z", 1, None)]
    df = spark.createDataFrame(rows, "g string, o int, id string").repartition(5)
    got = {r.g: (r.n_ids, r.digest) for r in tx.canonical_digest(df, ["g"], "id", "o").collect()}
    digest = lambda ids: hashlib.sha256(json.dumps(ids, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    for g in ("a", "b", None, "z"):
        ids = [i for _, i in sorted((o, i) for x, o, i in rows if x == g)]
        assert got[g] == (len(ids), digest(ids))
    whole = tx.canonical_digest(spark.range(1000).withColumn("o", F.col("id") * 7 % 1000), [], "id", "o").collect()
    assert [r.digest for r in whole] == [digest(sorted(range(1000), key=lambda i: i * 7 % 1000))]
    assert tx.canonical_digest(df.limit(0), ["g"], "id", "o").collect() == []


def test_scope_summary_golden(spark):
    """5 repairs of 13 and 1 regression of 37: Wilson bounds as published, and the exact p."""
    rows = [(True, i >= 5, i != 12) for i in range(13)] + [(False, i < 2, i != 0) for i in range(37)]
    df = spark.createDataFrame([(42, "c", "l", b, False, v, False, ok) for b, v, ok in rows], "seed int, category string, language string, b0_vulnerable boolean, b0_skipped boolean, is_vulnerable boolean, skipped boolean, valid boolean")
    out = outcomes.scope_summary(df).where("scope = 'overall' AND pooling = 'ALL'").first()
    assert [round(x, 6) for x in (out.repair_low, out.repair_high)] == [0.177097, 0.644771]
    assert (out.n_repaired, out.n_corrupted, out.n_regressed, out.n_unsafe_invalid, out.n_changed, out.status) == (5, 2, 1, 1, 7, "EVALUATED")
    assert abs(out.mcnemar_p - 2 * 7 / 64) < 1e-12
    none = outcomes.scope_summary(df.where("NOT b0_vulnerable")).where("scope = 'overall' AND pooling = 'ALL'").first()
    assert none.status == "NO_VULNERABLE_BASELINE" and none.repair_rate is None and none.repair_low is None
