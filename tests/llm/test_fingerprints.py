import random

from pyspark.sql import functions as F

from pairlab.llm import fingerprints as fp


def shingles(text):
    w = "".join(c if c not in "\t\n\v\f\r" else " " for c in (text or "").lower()).split(" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_estimates(spark):
    rng = random.Random(2)
    rows = []
    for i in range(30):
        a = ["w%d" % rng.randrange(3000) for _ in range(rng.choice([0, 1, 3, 5, 60, 900]))]
        b = a[: len(a) * 2 // 3] + ["x%d" % rng.randrange(3000) for _ in range(len(a) // 3)]
        rows.append((i, " ".join(a), "\n".join(b)))
    rows += [(90, None, ""), (91, "", "a"), (92, "A b", "a B")]
    df = spark.createDataFrame(rows, "doc_id long, a string, b string").select("*", fp.sketch(F.col("a")).alias("x"), fp.sketch(F.col("b")).alias("y"))
    out = df.select("doc_id", fp.resemblance(F.col("x"), F.col("y")).alias("j"), fp.containment(F.col("x"), F.col("y")).alias("c"), fp.distinct_shingles(F.col("x")).alias("n"), fp.distinct_shingles(fp.merge(F.col("x"), F.col("y"))).alias("u"), fp.fingerprint(F.col("x")).alias("f")).collect()
    for r, (_, a, b) in zip(sorted(out), rows, strict=True):
        s, t = shingles(a), shingles(b)
        exact = len(s | t) < fp.K
        assert abs(r.j - (len(s & t) / len(s | t) if s | t else 1)) < (1e-9 if exact else 0.2)
        assert abs(r.c - (len(s & t) / len(s) if s else 1)) < (1e-9 if exact else 0.3)
        assert abs(r.n / max(1, len(s)) - (1 if s else 0)) < 0.35 and abs(r.u - len(s | t)) <= 0.35 * len(s | t)
        assert len(r.f) == 12 * min(fp.K, len(s))


def test_merge_groups(spark):
    df = spark.createDataFrame([("g", list(range(0, 300, 2))), ("g", list(range(1, 300, 2))), ("h", [5]), ("e", []), (None, [7])], "k string, sketch array<long>")
    got = {r.k: r.sketch for r in fp.merge_groups(df, "k").collect()}
    assert got == {"g": list(range(fp.K)), "h": [5], "e": [], None: [7]}


def test_next(spark):
    rng = random.Random(4)
    ids = [*rng.sample(range(1000), 120), -(2**63), 2**63 - 1]
    df = spark.createDataFrame([(i, f"t{i}", "own") for i in ids], "doc_id long, text string, next_text string").repartition(7)
    order = sorted(ids, reverse=True)
    want = {a: f"t{b}" for a, b in zip(order, order[1:] + order[:1], strict=True)}
    for parts in (1, 3, 40):
        got = fp.with_next(df, "doc_id", "text", {"n": F.length("text")}, parts).collect()
        assert {r.doc_id: r.next_text for r in got} == want and len(got) == 122
        assert all(r.n == len(r.text) and r.next_n == len(r.next_text) for r in got)
    one = spark.createDataFrame([(5, "x")], "doc_id long, text string")
    assert fp.with_next(one, "doc_id", "text", {}, 4).first().next_text == "x"
    assert fp.with_next(one.limit(0), "doc_id", "text", {}, 4).count() == 0


def test_next_of_repeated_ids(spark):
    texts = [f"a{i}" for i in range(60)]
    rows = [(5, t) for t in texts] + [(5, "same")] * 20 + [(None, "n"), (None, "n"), (9, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for parts in (1, 8):
        got = fp.with_next(df, "doc_id", "text", {}, parts).collect()
        assert len(got) == len(rows)
        # Every row follows exactly one row, and ids come in order.
        assert sorted(r.next_text for r in got) == sorted(t for _, t in rows)
        assert [r.next_text for r in got if r.text == "c"][0] in [*texts, "same"]
        assert sorted(r.next_text for r in got if r.text == "n") == ["c", "n"]
        assert sum(r.text == "same" and r.next_text == "same" for r in got) == 19
