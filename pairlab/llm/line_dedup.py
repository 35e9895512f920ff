"""Removal of lines that resemble an earlier line, by an exact set-similarity join in built-in functions only.

A line's set is its distinct words (between space and the characters 0x09 to 0x0D). A line goes when an
earlier line, in order of document and line number, has a Jaccard similarity of ``tenths`` tenths (8) or more with it,
whether or not that line stays itself. Lines without words stay.

Words are coded as 64-bit integers whose upper byte grows with the word's frequency, so that sorting a set puts its
rare words first. Frequencies are counted over all lines in hashed classes; any order of words gives the same result,
only the work differs. Equal sets are one class, known by its first line and numbered in order of first lines.

Classes meet on the words of their prefixes (so many that two similar sets must share one there) and are filtered by
length, by the words that can still match from a position on, and by the words that only one of them has: those before
the first shared one, and of those behind it one for each bit that differs in 64 bits of each set, or 128 of sets with
more than 64 words (a word flips one). What is left is verified on the full sets of the
lines. A class needs only one earlier match, so this is done in two steps: each class first meets the leaders that most of
a few of its words have (the first class that chose a word, in each of four parts of all classes); only classes for which
none of these is a match meet all earlier ones. Groups of many variants of a line are settled by their leaders, so that
candidates don't grow with the square of such a group.

Defined cases: a null text has one empty line; a row with a null id is left as it is and is no source; of rows that
repeat an id, each is a text of its own, ordered by the hash of its text, and exact copies keep the same lines; an empty
table gives an empty result; extra columns are carried by name, and the operator's own columns win.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.llm.common import cut, discard, new_place
from pairlab.llm.fingerprints import let

#: Hashed classes in which the frequencies of words are counted.
WIDTH = 1 << 19
#: Words by which a class looks for its leader.
FEW = 4
#: Parts of all classes, each of which has its leaders.
PARTS = 4
#: Separators of words besides the space; a line break only ends lines.
BLANKS = "\t\x0b\x0c\r"


def spaced(text: Column) -> Column:
    """The text with a space for every separator of words. Splitting at one character needs no regular expression."""
    odd = reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in BLANKS])
    return F.when(odd, F.translate(text, BLANKS, " " * len(BLANKS))).otherwise(text)


def hashed_words(line: Column) -> Column:
    """The words of a line of a spaced text, as hashes; an empty word gives one too."""
    return F.transform(F.split(line, " "), lambda w: F.xxhash64(w))


def distinct_words(line: Column) -> Column:
    """The distinct words of a line of a spaced text, as hashes."""
    return F.array_remove(F.array_distinct(hashed_words(line)), F.xxhash64(F.lit("")))


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, line_no, line) of documents (doc_id, text)."""
    return docs.select(
        "doc_id",
        F.xxhash64("text").alias("text_hash"),
        F.posexplode(F.split(spaced(F.col("text")), "\n")).alias("line_no", "line"),
    )


def word_levels(texts: DataFrame) -> Column:
    """An array with a frequency level from 0 to 63 for each hashed class of words."""
    words = texts.select(
        F.explode(F.split(F.replace(spaced(F.col("text")), F.lit("\n"), F.lit(" ")), " ")).alias("w"),
    ).where("w != ''")
    place = F.xxhash64("w").bitwiseAND(WIDTH - 1).cast("int")
    counts = words.groupBy(place.alias("c")).agg(F.count("*").alias("n")).toArrow()  # at most WIDTH rows
    levels = np.zeros(WIDTH, int)
    levels[counts["c"].to_numpy()] = np.frexp(counts["n"].to_numpy().astype(float))[1]
    # Spark folds this into one constant, as it would not with a lambda function in it.
    return F.split(F.lit(",".join(map(str, levels.tolist()))), ",").cast("array<tinyint>")


def coded(line: Column, levels: Column) -> Column:
    """The set of a line in order of rarity: frequency level in the upper byte, then the word's hash."""
    code = lambda h: F.shiftleft(F.get(levels, h.bitwiseAND(WIDTH - 1).cast("int")).cast("long"), 56).bitwiseOR(F.shiftrightunsigned(h, 8))
    return F.sort_array(F.transform(distinct_words(line), code))


def marked(words: Column) -> Column:
    """64 bits, of which each word flips one."""
    return F.aggregate(
        words,
        F.lit(0).cast("long"),
        lambda a, w: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), w.bitwiseAND(63).cast("int"))),
    )


def upper(word: Column) -> Column:
    """Whether a word belongs to the upper half of a set's bits."""
    return word.bitwiseAND(64) != 0


def entries(classes: DataFrame) -> DataFrame:
    """(ord, n, pos, word, low, high) of each prefix word of classes, with the bits of the words that follow it."""
    passed = F.slice("prefix", F.lit(1), F.col("pos") + 1)
    large = F.col("n") > 64
    low = F.when(large, marked(F.filter(passed, lambda w: ~upper(w)))).otherwise(marked(passed))
    high = F.when(large, marked(F.filter(passed, upper))).otherwise(0)
    placed = classes.select(
        "ord",
        F.col("n").cast("int").alias("n"),
        "low",
        "high",
        "prefix",
        F.posexplode("prefix").alias("pos", "word"),
    )
    return placed.select(
        "ord",
        "n",
        "pos",
        "word",
        F.col("low").bitwiseXOR(low).alias("low"),
        F.col("high").bitwiseXOR(high).alias("high"),
    )


def may_match(tenths: int) -> Column:
    """Whether two sets (n, pos, low, high; m, at, low2, high2) may be similar if these positions hold the first word that
    they share: by length, and by the words that only one has: all before the positions, as sets are in one order, and
    one at least for each bit in which what follows differs."""
    least, both = tenths * (F.col("n") + F.col("m")), 10 + tenths
    differ = lambda a, b: F.bit_count(a.bitwiseXOR(b))
    folded = differ(F.col("low").bitwiseXOR(F.col("high")), F.col("low2").bitwiseXOR(F.col("high2")))
    after = F.when(
        (F.col("n") > 64) & (F.col("m") > 64),
        differ(F.col("low"), F.col("low2")) + differ(F.col("high"), F.col("high2")),
    ).otherwise(folded)
    apart = F.col("pos") + F.col("at") + after
    rest = F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("at"))
    # What is shared is half of all words but those that only one set has.
    return (10 * F.least("n", "m") >= tenths * F.greatest("n", "m")) & (both * rest >= least) & (
        both * (F.col("n") + F.col("m") - apart) >= 2 * least
    )


def verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, tenths: int) -> DataFrame:
    """The classes x of pairs (x, y) whose sets are similar, from the lines themselves. Each x is given once. The pairs and
    the sets are emptied in the end, as they would lie beside what is shuffled next."""
    pairs_at, full_at = new_place(pairs.sparkSession), new_place(pairs.sparkSession)
    pairs = cut(pairs, pairs_at)
    wanted = classes.join(pairs.select(F.explode(F.array("x", "y")).alias("ord")).distinct(), "ord").select(
        "ord",
        "doc_id",
        "text_hash",
        "line_no",
    )
    by_text = wanted.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("line_no", "ord")).alias("lines"))
    held = texts.withColumn("text_hash", F.xxhash64("text")).join(
        by_text.hint("shuffle_hash"),
        ["doc_id", "text_hash"],
    ).dropDuplicates(["doc_id", "text_hash"])
    picked = let(
        F.split(spaced(F.col("text")), "\n"),
        lambda x: F.transform("lines", lambda i: F.struct(i.ord.alias("ord"), F.get(x, i.line_no).alias("line"))),
    )
    full = cut(
        held.select(F.explode(picked).alias("l")).select("l.ord", distinct_words(F.col("l.line")).alias("set")),
        full_at,
    )
    both = pairs.join(full.select(F.col("ord").alias("x"), F.col("set").alias("sx")), "x").join(
        full.select(F.col("ord").alias("y"), F.col("set").alias("sy")),
        "y",
    )
    alike = (10 + tenths) * F.size(F.array_intersect("sx", "sy")) >= tenths * (F.size("sx") + F.size("sy"))
    similar = cut(both.where(alike).select("x").distinct())
    discard(full, full_at)
    discard(pairs, pairs_at)
    return similar


def matched_classes(classes: DataFrame, texts: DataFrame, tenths: int) -> DataFrame:
    """(ord) of the classes that are similar to an earlier one, from (ord, doc_id, text_hash, line_no, n, low, high, prefix)."""
    # A few words of each prefix, chosen by hash, so that variants of a line mostly choose the same.
    few = F.slice(F.array_sort(F.transform("prefix", lambda w: F.xxhash64(w))), 1, FEW)
    chosen = classes.select("ord", F.explode(few).alias("word"))
    # One leader for each part of the classes, as a variant may be unlike the first but like others.
    part = F.pmod(F.xxhash64("ord"), F.lit(PARTS))
    least = [F.min(F.when(part == i, F.col("ord"))).alias(f"y{i}") for i in range(PARTS)]
    leaders = chosen.groupBy("word").agg(
        F.min("ord").alias("first"),
        F.max("ord").alias("last"),
        *least,
    ).where("first < last")
    found = F.explode(F.array(*(F.struct(F.lit(i).alias("part"), F.col(f"y{i}").alias("y")) for i in range(PARTS))))
    met = chosen.withColumnRenamed("ord", "x").join(leaders, "word").select("x", found.alias("l")).where("l.y < x")
    often = met.groupBy("x", "l.part", "l.y").agg(F.count("*").alias("shared")).where("shared > 1")
    best = often.groupBy("x", "part").agg(F.max_by("y", F.struct("shared", -F.col("y"))).alias("y")).select("x", "y")
    led = verified(best, classes, texts, tenths)
    rest = entries(classes.join(led.withColumnRenamed("x", "ord"), "ord", "left_anti")).withColumnRenamed("ord", "x")
    earlier = entries(classes).select(
        F.col("ord").alias("y"),
        F.col("n").alias("m"),
        F.col("low").alias("low2"),
        F.col("high").alias("high2"),
        F.col("pos").alias("at"),
        "word",
    )
    pairs = rest.join(earlier, "word").where(
        (F.col("y") < F.col("x")) & may_match(tenths),
    ).select("x", "y").distinct()
    return led.unionByName(verified(pairs, classes, texts, tenths)).withColumnRenamed("x", "ord")


def dedup_lines(
    df: DataFrame,
    tenths: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, text (without the removed lines), n_lines, n_removed of every row, and the columns of keep."""
    if not 8 <= tenths <= 10:
        raise ValueError("the similarity must be from 0.8 to 1")
    keep = tuple(c for c in keep if c not in ("doc_id", "text", "n_lines", "n_removed", id_col, text_col))
    docs = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        *keep,
    )
    named = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    levels = word_levels(named)
    place = ["doc_id", "text_hash", "line_no"]
    n = F.size("set")
    reach = n - F.floor((tenths * n + 9) / 10).cast("int") + 1
    # Words in prefixes are told apart by 31 bits; words that meet by chance only add candidates, which the bits decide.
    prefix = F.transform(F.slice("set", F.lit(1), reach), lambda w: w.bitwiseAND(0x7FFFFFFF).cast("int"))
    described = lines_of(named).select(*place, coded(F.col("line"), levels).alias("set"))
    # Half of the words go to either half of the bits; those of small sets lie over one another.
    low = F.when(n > 64, marked(F.filter("set", lambda w: ~upper(w)))).otherwise(marked(F.col("set")))
    high = F.when(n > 64, marked(F.filter("set", upper))).otherwise(0)
    lines_at = new_place(df.sparkSession)
    lines = cut(
        described.select(
            *place,
            n.alias("n"),
            F.xxhash64("set").alias("h1"),
            F.hash("set", F.lit(7)).alias("h2"),
            low.alias("low"),
            high.alias("high"),
            F.when(n >= 4, prefix).alias("prefix"),
        ),
        lines_at,
    )
    some = lines.where("n > 0")
    # Each class of equal sets with its first line. Sets of fewer than four words have no similar ones but equal ones.
    first = F.min_by(F.struct(*place, "low", "high", "prefix"), F.struct(*place))
    sets = some.groupBy("h1", "h2", "n").agg(first.alias("f"), F.count("*").alias("copies")).select(
        "h1",
        "h2",
        "n",
        "f.*",
        "copies",
    )
    classes = cut(
        sets.repartitionByRange(*place).sortWithinPartitions(*place).withColumn(
            "ord",
            F.monotonically_increasing_id(),
        ),
    )
    every = cut(some.drop("low", "high", "prefix"))
    discard(lines, lines_at)
    matched = matched_classes(classes.where("n >= 4"), named, tenths)
    known = classes.join(matched.withColumn("matched", F.lit(True)), "ord", "left").where("copies > 1 OR matched")
    known = known.select(
        "h1",
        "h2",
        "n",
        F.struct(*place).alias("first"),
        F.coalesce("matched", F.lit(False)).alias("matched"),
    )
    gone = every.select(*place, "n", "h1", "h2").join(known, ["h1", "h2", "n"]).where(
        F.col("matched") | (F.struct(*place) > F.col("first")),
    ).select(*place)
    removed = cut(gone.groupBy("doc_id", "text_hash").agg(F.collect_set("line_no").alias("removed")))
    all_lines = F.split("text", "\n")
    left = let(
        all_lines,
        lambda x: F.array_join(
            F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("removed")), lambda i: F.get(x, i)),
            "\n",
        ),
    )
    joined = docs.withColumn("text_hash", F.xxhash64("text")).join(
        removed.hint("shuffle_hash"),
        ["doc_id", "text_hash"],
        "left",
    )
    return joined.select(
        "doc_id",
        F.when(F.col("removed").isNull(), F.col("text")).otherwise(left).alias("text"),
        F.size(all_lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        *keep,
    )
