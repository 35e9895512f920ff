import os
import random
import re

from pairlab.llm import line_dedup
from pairlab.llm.common import shared_folder


def brute(rows):
    lines = []
    for doc, text in rows:
        for no, line in enumerate((text or "").split("\n")):
            lines.append((doc, no, frozenset(w for w in re.findall(r"[^\x20\x09-\x0D]+", line)), line))
    out = {}
    for doc, no, words, line in sorted(lines, key=lambda r: r[:2]):
        gone = bool(words) and any(10 * len(words & w) >= 8 * len(words | w) for d, n, w, _ in lines if w and (d, n) < (doc, no))
        out.setdefault(doc, []).append((line, gone))
    return {d: ("\n".join(x for x, g in v if not g), len(v), sum(g for _, g in v)) for d, v in out.items()}


def test_matches_brute_force(spark):
    rng = random.Random(8)
    vocabulary = ["the", "of", "and", "été", *("w%d" % i for i in range(60))]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randrange(1, 16))] for _ in range(25)]
    bases += [["l%d" % i for i in rng.sample(range(300), n)] for n in (60, 64, 66, 70, 90, 200)]

    def line():
        words = list(rng.choice(bases))
        for _ in range(rng.randrange(0, 3 + len(words) // 12)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        return rng.choice(["", " ", "\t"]) + rng.choice([" ", "  ", "\r"]).join(rng.sample(words, len(words)))

    rows = [(i * 7 % 101, "\n".join(rng.choice([line(), line(), "", "  "]) for _ in range(rng.randrange(0, 8)))) for i in range(80)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "the of\nof  the\nof the"), (204, "x")]
    df = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, n_lines int").repartition(4)
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(df).collect()}
    assert got == brute(rows)


def test_odd_rows(spark):
    rows = [(None, "a b c"), (1, "a b c\nx"), (1, "a b c\nx"), (2, "c b a"), (1, "zz\na b c")]
    df = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, lang string")
    got = sorted(((r.doc_id, r.text, r.lang) for r in line_dedup.dedup_lines(df, keep=("lang",)).collect()), key=str)
    assert len(got) == 5 and (None, "a b c", "k") in got and (2, "", "k") in got
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_sets_that_are_done_with_are_emptied(spark):
    """The words of verified lines don't stay in the shared folder while more is shuffled."""
    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    rows = [(i, f"a b c d e f g h i {i % 9}\nthe x{i} y{i} z{i} u{i} v{i} w{i} " + " ".join(f"q{i // 2}{j}" for j in range(30))) for i in range(60)]
    line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    tables = [spark.read.parquet(f"{folder}/{d}") for d in set(os.listdir(folder)) - before]
    done_with = [t for t in tables if t.columns in (["ord", "set"], ["x", "y"])]
    assert len(done_with) == 4 and all(t.isEmpty() for t in done_with)
