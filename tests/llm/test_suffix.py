import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pairlab.llm import suffix


def brute(rows, width=50):
    first = {}
    for doc, text in rows:
        b = (text or "").encode()
        for i in range(len(b) - width + 1):
            w = b[i : i + width]
            if doc is not None:
                first[w] = min(first.get(w, doc), doc)
    out = []
    for doc, text in rows:
        b = (text or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - width + 1):
            if doc is not None and first[b[i : i + width]] < doc:
                gone[i : i + width] = [True] * width
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def kept(rows, width=50):
    """The bytes that stay of each of a list of documents with ids of their own."""
    first = {}
    for doc, text in rows:
        b = text.encode()
        for i in range(len(b) - width + 1):
            first[b[i : i + width]] = min(first.get(b[i : i + width], doc), doc)
    out = {}
    for doc, text in rows:
        b = text.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if first[b[i : i + width]] < doc:
                gone[i : i + width] = b"\x01" * width
        out[doc] = bytes(x for x, g in zip(b, gone) if not g)
    return out


def texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé ") for _ in range(rng.randrange(1, 6)))
    passages = [" ".join(word() for _ in range(rng.randrange(10, 60))) for _ in range(6)]
    rows = []
    for i in range(60):
        text = "".join(rng.choice([*passages, word() * 3, "ab" * rng.randrange(60), "x" * rng.randrange(120), rng.choice(passages)[5:70]]) for _ in range(rng.randrange(0, 7)))
        rows.append((i * 3 % 61, text))
    rows += [(7, rows[3][1]), (7, "other " + passages[0]), (None, passages[1]), (None, None), (70, None), (71, ""), (72, rows[5][1]), (72, rows[5][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_brute_force(spark, seed):
    rows = texts(seed)
    df = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, n_spans int").repartition(5)
    got = [(r[0], r[1], r[2], r[3], hashlib.sha256(r[4]).hexdigest()) for r in suffix.remove_repeats(df).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_hot_digits_are_not_held(spark, monkeypatch):
    rng = random.Random(4)
    around = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    phrase, tails = "Licensed under the terms of it", [around(40) for _ in range(4)]
    rows = [(i, around(rng.randrange(50)) + phrase + rng.choice([*tails, around(40)]) + around(60)) for i in range(80)]
    sort = suffix._sort_contested

    def bounded(width):
        run = sort(width)

        def counted(batches):
            seen = Counter()
            for batch in batches:
                seen.update(batch.column(0).to_pylist())
                assert not seen or max(seen.values()) <= 10
                yield batch

        return lambda batches: run(counted(batches))

    monkeypatch.setattr(suffix, "MOST", 10, raising=False)
    monkeypatch.setattr(suffix, "_sort_contested", bounded)
    got = [(r[0], r[1], r[2], r[3], hashlib.sha256(r[4]).hexdigest()) for r in suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()]
    assert sorted(got, key=str) == brute(rows) and any(r[2] for r in got)


def test_cut_characters(spark):
    passage = "é" * 40
    df = spark.createDataFrame([(1, "x" + passage), (2, "yz" + "é" * 25 + "è" * 3), (3, "plain")], "doc_id long, text string")
    kept = {r.doc_id: (bytes(r.kept_bytes), r.text) for r in suffix.kept_text(suffix.remove_repeats(df)).collect()}
    assert all(text == raw.decode("utf-8", "replace") for raw, text in kept.values())
    assert kept[2][0] != ("yz" + "é" * 25 + "è" * 3).encode() and kept[3][1] == "plain"
    half = spark.createDataFrame([(b"a\xc3",), (b"\xa9b",)], "kept_bytes binary")
    assert [r.text for r in suffix.kept_text(half).collect()] == ["a\ufffd", "\ufffdb"]


def test_empty_table(spark):
    assert suffix.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("empty", [False, True])
def test_clashing_columns(spark, empty):
    """Columns that are carried along may have any names, those of the operator's inside too."""
    passage = "".join(map(str, range(40)))
    names = ["text", "items", "__text", "__items", "__mark", "__keep0", "digit", "place", "content", "1"]
    df = spark.createDataFrame([(1, passage, *names), (2, "x" + passage, *names), (None, passage, *names)], ["doc_id", "body", *names])
    df = df.limit(0) if empty else df
    out = suffix.remove_repeats(df, text_col="body", keep=(*names, "spans", "text"))
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_bytes", "spans", *names]
    rows = out.collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in rows) == ([] if empty else [("1", 0), ("2", len(passage)), ("None", 0)])
    assert all([r[n] for n in names] == names for r in rows)


def test_many_texts_of_one_id(spark):
    """Rows of one id lose their own bytes only, however alike their hashes are."""
    rng = random.Random(9)
    around = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    shared = [around(70) for _ in range(5)]
    rows = [(0, " ".join(shared))] + [(5, around(rng.randrange(40)) + rng.choice([*shared, "none"]) + around(20)) for _ in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [(r[0], r[1], r[2], r[3], hashlib.sha256(r[4]).hexdigest()) for r in suffix.remove_repeats(df).collect()]
    assert sorted(got, key=str) == brute(rows)
    marks = suffix.with_marks(df.withColumnRenamed("text", "__text")).where("doc_id = 5").select("__text", "__mark").distinct().collect()
    assert len({r["__mark"] for r in marks}) == len(marks) and min(r["__mark"] for r in marks) == 0


def test_sorting_contested_runs_takes_little_memory():
    """100,000 runs of 20,000 digits, each of five documents: what is found is whole, and few are held at once."""
    rng = np.random.default_rng(3)
    digits, each = 20_000, 5
    digit = np.repeat(np.arange(digits), each)
    doc = np.tile(np.arange(each), digits)
    start = digit * 100
    texts = [rng.bytes(60) for _ in range(digits)]
    held = [texts[d][: 60 - d % 2] + bytes([k]) for d, k in zip(digit.tolist(), doc.tolist())]
    left = np.full(len(doc), 20)
    place = start << 16 | left << 8 | np.fromiter(map(len, held), np.int64) - 50
    batches = [
        pa.RecordBatch.from_arrays([pa.array(x[i : i + 10_000]) for x in (digit, doc, place, held)], names=["digit", "doc_id", "place", "bytes"])
        for i in range(0, len(doc), 10_000)
    ]
    tracemalloc.start()
    found = Counter()
    for out in suffix._sort_contested(50)(iter(batches)):
        for d, p in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):
            found[d, p >> 16, p & 255] += 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # All windows but the last, which holds the last byte, are also the first document's.
    want = Counter((d, s, n - 51) for d, s, n in zip(doc.tolist(), start.tolist(), map(len, held)) if d)
    covered = lambda c: Counter({(d, s + i): 0 for d, s, n in c for i in range(n + 1)})
    assert set(covered(found)) == set(covered(want)) and sum((n + 1) * k for (_, _, n), k in found.items()) == sum((n + 1) * k for (_, _, n), k in want.items())
    assert peak < 100e6, peak
