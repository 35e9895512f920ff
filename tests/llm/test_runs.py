import hashlib
import random

import pandas as pd
import pytest

from pairlab.llm import queries, runs

SF = "/root/testdata/sf0.001"


def brute(w, ratio=4, least=6):
    """Every maximal run of words with its smallest period, by comparing words at each distance."""
    out = []
    for q in range(1, len(w) // ratio + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= max(least, ratio * q) and not any(w[i : i + size - d] == w[i + d : i + size] for d in range(1, q)):
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def left(w, found):
    gone = {i for start, size, q in found for i in range(start + q, start + size)}
    return [x for i, x in enumerate(w) if i not in gone]


def made(rng):
    k = rng.choice([1, 2, 2, 3, 5, 20])
    w = [b"w%d" % rng.randrange(k) for _ in range(rng.randrange(0, 40))]
    for _ in range(rng.randrange(0, 3)):
        a, block = rng.randrange(0, len(w) + 1), [b"w%d" % rng.randrange(k) for _ in range(rng.randrange(1, 6))]
        w[a:a] = (block * 8)[: rng.randrange(1, 40)]
    return w


@pytest.mark.parametrize("seed", range(4))
def test_random_words(seed):
    rng = random.Random(seed)
    for _ in range(200):
        texts = [made(rng) for _ in range(rng.randrange(1, 5))]
        ratio, least = rng.choice([(2, 2), (2, 6), (3, 6), (4, 2), (4, 6)])
        want = [brute(w, ratio, least) for w in texts]
        assert runs.runs_of_texts(texts, ratio, least) == want
        assert [runs.periodic_runs(w, ratio, least) for w in texts] == want
        assert [runs.collapsed(w, r).split() for w, r in zip(texts, want, strict=True)] == [left(w, r) for w, r in zip(texts, want, strict=True)]


def test_long_periods():
    rng = random.Random(5)
    for period in (1, 2, 7, 255, 256, 257, 1000):
        block = [b"%d" % rng.randrange(10**6) for _ in range(period)]
        for size in (max(6, 4 * period), 5 * period + period // 2 + 4):
            head, tail = ([b"%d" % rng.randrange(10**6, 10**7) for _ in range(300)] for _ in range(2))
            w = head + (block * (size // period + 1))[:size] + tail
            assert runs.runs_of_texts([w, head, w]) == [[(300, size, period)], [], [(300, size, period)]]
            short = head + (block * (size // period + 1))[: max(6, 4 * period) - 1] + tail
            assert runs.runs_of_texts([short]) == [[]]


def test_the_tree_changes_paths_seldom():
    """Recolouring takes few steps where a text is one long run: no path is climbed node by node."""
    block = [b"%d" % i for i in range(50)]
    names: dict = {}
    words = [names.setdefault(w, len(names)) for w in block * 200]
    seen = []
    access = runs.RecencyTree.access
    runs.RecencyTree.access = lambda self, x, end: seen.append(len(found := access(self, x, end))) or found
    try:
        assert runs.periodic_runs(words) == [(0, 10_000, 50)]
    finally:
        runs.RecencyTree.access = access
    assert sum(seen) < 5 * len(words)


def test_defined_cases(spark):
    rows = [
        (1, "a a a a a a", "r"),
        (1, "a a a a a a", "r"),
        (2, None, None),
        (3, "", "x"),
        (None, "b c " * 4 + "d", "n"),
        (4, "ü\x0b ü\tü\nü\rü\x0cü \x1c   a", "u"),
        (-5, " \n ", "s"),
        (6, "x y " * 20_000, "long"),
        (7, "a a a a a", "short"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = runs.find_runs(df, keep=("runs", "text"))
    assert got.columns == ["doc_id", "text", "n_words", "runs", "collapsed"]
    found = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()), key=str)
    want = []
    for d, t, _ in rows:
        w = (t or "").encode().split()
        r = brute(w) if d != 6 else [(0, 40_000, 2)]
        want.append((d, len(w), r, b" ".join(left(w, r)).decode()))
    assert found == sorted(want, key=str)
    odd = df.select("doc_id", df.text.alias("__text"), df.runs.alias("collapsed"))
    assert runs.find_runs(odd, "__text", keep=("__text", "collapsed")).count() == len(rows)
    assert runs.find_runs(df.limit(0)).collect() == []
    with pytest.raises(ValueError, match="two periods"):
        runs.find_runs(df, ratio=1)


def test_query(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs)
    planted = 0
    for doc, text in zip(docs["doc_id"].tolist(), docs["text"], strict=True):
        w = queries.periodic_tail(doc, (text or "").encode().split())
        planted += w != (text or "").encode().split()
        found, r = brute(w), got[doc]
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if found else None)
        assert r.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % x for x in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(left(w, found))).hexdigest()
    assert planted > 5


def test_periodic_tail():
    import zlib

    words = [b"%d" % i for i in range(100)]
    for doc in range(500):
        h = zlib.crc32(str(doc).encode())
        g, n, want = h // 10, 100, list(words)
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            for i in range(a, n):
                want[i] = words[a + (i - a) % p]
        assert queries.periodic_tail(doc, list(words)) == want
    assert queries.periodic_tail(None, words) == words and queries.periodic_tail(0, []) == []
