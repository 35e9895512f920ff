import random

from pairlab.llm import minhash
from pairlab.llm.components import connected_components


def components(nodes, links):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(root[a], root[b])
            if root[a] != m or root[b] != m:
                root[a] = root[b] = m
                changed = True
    return root


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(400, 440)]
    df = spark.createDataFrame([*edges, (None, 3), (5, 5)], "a long, b long")
    want = components({x for e in edges for x in e}, edges)
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {n: c for n, c in want.items() if any(n in e and e[0] != e[1] for e in edges)}


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_matches_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "w%d" % rng.randrange(4000)
    rows = []
    for group in range(12):
        base = [word() for _ in range(rng.randrange(30, 200))]
        for _ in range(rng.randrange(1, 30)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), " \t".join(copy)))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "One two"), (1004, "one TWO"), (None, rows[0][1]), (1005, rows[4][1].upper()), (1005, rows[4][1]), (1006, "é É")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, component_id string")
    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    links = [(a, b) for i, (a, s) in enumerate(sets) for b, t in sets[:i] if s and t and 100 * len(s & t) >= 85 * len(s | t)]
    want = components({d for d, _ in sets}, links)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted(((d, len(shingles(t)), want.get(d), d is None or want[d] == d) for d, t in rows), key=str)


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 7)
    test_matches_brute_force(spark)


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
