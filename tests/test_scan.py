"""Literals of patterns, rule tables of thousands of rules, and mapped rule ids."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from pairlab.operators import scan

LITERALS = [
    ("abc", "abc"),
    (r"a\.bcd", "a.bcd"),
    ("[Ll]icense", "icense"),
    (r"\bword\b", "word"),
    ("ab?cde", "cde"),
    ("abc*", "ab"),
    ("abc+d", "abc"),
    ("ab{0,2}cd", "cd"),
    ("x(?:long|longer)yz", "yz"),
    ("abc|def", ""),
    ("(?i)abc", ""),
    ("pre(a|b)?post", "post"),
    (r"@mail\d\.example\.com", ".example.com"),
    (r"[\]abc]+tail", "tail"),
    ("[^]]x", "x"),
    (r"\x41bc", ""),
    (r"\|", "|"),
    ("", ""),
    ("^start.*end$", "start"),
    ("a[b[cd]]efg", "efg"),
]


@pytest.mark.parametrize(("pattern", "literal"), LITERALS)
def test_required_literal(pattern, literal):
    assert scan.required_literal(pattern) == literal


def test_a_match_holds_its_literal():
    rng = random.Random(1)
    pieces = ["ab", "c", "d?", "e+", "f*", "[gh]", "(ij)?", "(k|l)", ".", "m{2}", "n{0,1}", r"\.", r"\d"]
    for _ in range(3000):
        pattern = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 6)))
        text = "".join(rng.choice("abcdefghijklmn.5") for _ in range(12)) + "abcdeee.mm5"
        m = re.search(pattern, text)
        assert not m or scan.required_literal(pattern) in m.group()


def test_word_boundaries_are_ascii(spark):
    """As in Python with re.ASCII, whatever the JVM takes for a letter."""
    rng = random.Random(2)
    pieces = [r"\b", r"\b", r"\B", "a", "k", "é", "_", "1", r"\d", r"\w", r"\W", "a?", r"\d{1,2}", "a{0,1}", r"\\\\", "[b_]", "[^]b]", "(?:a|1)", "|"]
    texts = ["".join(rng.choice("aké_1 b\\中\u0301٣-") for _ in range(rng.randrange(1, 9))) for _ in range(150)]  # Python has no \B in an empty one
    patterns = [r"tion\b", r"\b\d+", *("".join(rng.choice(pieces) for _ in range(rng.randrange(1, 6))) for _ in range(250))]
    df = spark.createDataFrame([(t,) for t in [*texts, "tioné", "é12"]], "t string")
    found = df.select("t", scan.scan_rules("t", [(str(i), "r", p) for i, p in enumerate(patterns)]).category.alias("c")).collect()
    for t, c in found:
        assert c == [str(i) for i, p in enumerate(patterns) if re.search(p, t, re.ASCII)], ascii(t)


def test_what_is_no_word_boundary_stays():
    for p in [r"\\\\b", r"\Qa\b\E", r"\b{g}", "[]b]", r"[\]b]", "", "\\"]:
        assert scan.ascii_boundaries(p) == p
    assert scan.ascii_boundaries(r"\Qa\b\E\bx") == r"\Qa\b\E(?<!\w)x"


def test_records_scanned_by_other_boundaries_are_scanned_again(spark):
    plain = lambda rules: F.sha2(F.lit("\n".join("\t".join(r) for r in rules)), 256).alias("rules_hash")  # noqa: E731  as it was
    new = spark.createDataFrame([(1, "tioné")], "id int, t string")
    for rules, n in (([("c", "r", r"tion\b")], 1), ([("c", "r", "tion")], 0)):
        assert scan.scan_incremental(new, new.select("id", plain(rules)), "id", "t", rules).count() == n


def rule_rows(n, rng):
    rows = [(f"c{i % 9}", i, f"r{i}", rng.choice([r"\bfn%d\(", "call%d[a-z]*;", "key%d=(a|b)"]) % i) for i in range(n)]
    return [*rows, ("short", n, "short", "q|z"), ("c1", n + 1, "late", r"\d{4}")]


def test_many_rules_find_the_same(spark):
    rng = random.Random(4)
    rules = rule_rows(300, rng)
    texts = [(i, " ".join(rng.choice([f"fn{rng.randrange(400)}(x)", f"call{rng.randrange(400)}ab;", f"key{rng.randrange(400)}=b", "q", "word"]) for _ in range(rng.randrange(9)))) for i in range(200)]
    df = spark.createDataFrame([*texts, (500, None), (501, "")], "id int, t string")
    table = spark.createDataFrame(rules, "category string, rule_order int, rule_id string, pattern string")
    got = sorted(map(tuple, scan.scan_rule_table(df, "id", "t", table).collect()))
    want = []
    for i, t in texts:
        first = {}
        for c, _, r, p in rules:
            if c not in first and re.search(p, t):
                first[c] = r
        want += [(i, c, r) for c, r in first.items()]
    assert got == sorted(want)


def test_many_rules_have_ascii_boundaries(spark):
    rules = [*((f"c{i}", i, f"r{i}", rf"fn{i}\b") for i in range(70)), ("short", 70, "short", r"\bx\b")]
    df = spark.createDataFrame([(1, "fn7é"), (2, "éx"), (3, "fn77 xx fn_8")], "id int, t string")
    table = spark.createDataFrame(rules, "category string, rule_order int, rule_id string, pattern string")
    assert sorted(map(tuple, scan.scan_rule_table(df, "id", "t", table).collect())) == [(1, "c7", "r7"), (2, "short", "short")]


def test_two_thousand_rules_cost_less_than_twice_twenty(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(2000)]
    df = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(400))) for i in range(1500)], "id int, t string").repartition(4).cache()
    df.count()

    def cost(n):
        rows = [(f"c{i % 9}", i, f"r{i}", rf"\bfn{i}x\w+\(") for i in range(n)]
        table = spark.createDataFrame(rows, "category string, rule_order int, rule_id string, pattern string")
        took = []
        for _ in range(3):
            began = time.time()
            scan.scan_rule_table(df, "id", "t", table).count()
            took.append(time.time() - began)
        return min(took)

    few, many = cost(20), cost(2000)
    df.unpersist()
    assert many < 2 * few + 1.5  # and what a small job and a Python worker take


def test_mapped_ids_meet_by_grams(spark):
    mapping = spark.createDataFrame([("abc", "exact", 9), ("bc", "two", 3), ("c", "one", 4), ("xyzzy", "long", 0), ("", "any", 50), ("bcd", "three", 3)], "rule_id string, category string, order int")
    ids = ["abc", "abcd", "zzc", "aaxyzzyb", "none", "", None, "xyz"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(ids)], "n int, rule_id string")
    out = scan.map_rules(df, mapping)
    got = {r.rule_id: r.category for r in out.collect()}
    assert got in ({"abc": "exact", "abcd": c, "zzc": "one", "aaxyzzyb": "long", "none": "any", "": "any", None: None, "xyz": "any"} for c in ("two", "three"))
    assert out.count() == len(ids)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
