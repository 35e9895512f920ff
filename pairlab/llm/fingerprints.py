"""Document fingerprints: bottom-k sketches of word shingles, in built-in functions only.

A sketch is the sorted array of the ``k`` least 48-bit hashes among a text's distinct shingles of five words (words lie
between space and the characters 0x09 to 0x0D and are lower-cased; a shorter text has one shingle of all its words).
Sketches of parts merge into the sketch of the whole, and estimate resemblance, containment and the number of distinct
shingles. Below k shingles all estimates are exact.

Defined cases: a null or blank text has an empty sketch; two empty sketches resemble each other fully, an empty and
another one not at all; equal texts have equal sketches; repeated rows each give a row.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlab.llm.common import words_native

K = 128
#: Hashes are from 0 to this.
TOP = 2**48


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sketch(text: Column, k: int = K, size: int = 5) -> Column:
    """The bottom-k sketch of a text, as array<long>."""

    def shingles(h: Column) -> Column:
        many = F.transform(
            F.sequence(F.lit(0), F.size(h) - size),
            lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(size))),
        )
        return F.when(F.size(h) >= size, many).when(F.size(h) > 0, F.array(F.xxhash64(h, F.lit("short")))).otherwise(
            F.array().cast("array<bigint>"),
        )

    hashed = F.transform(words_native(F.lower(text)), lambda w: F.xxhash64(w))
    low = F.transform(let(hashed, shingles), lambda x: F.shiftrightunsigned(x, 16))
    return F.slice(F.sort_array(F.array_distinct(low)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two sketched parts together."""
    return F.slice(F.sort_array(F.array_distinct(F.concat(a, b))), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity, from 0 to 1."""
    both = F.array_intersect(a, b)
    return let(
        merge(a, b, k),
        lambda m: F.when(F.size(m) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(both, m)) / F.size(m)),
    )


def distinct_shingles(s: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles."""
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise(
        F.lit(float(k - 1)) * TOP / F.get(s, F.lit(k - 1)),
    )


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too."""
    j, na, nb = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j / (1 + j) * (na + nb) / na))


def fingerprint(s: Column) -> Column:
    """A sketch as text: twelve hexadecimal digits for each hash."""
    return F.array_join(F.transform(s, lambda x: F.lpad(F.lower(F.hex(x)), 12, "0")), "")


def merge_groups(df: DataFrame, key: str, sketch_col: str = "sketch", k: int = K) -> DataFrame:
    """One sketch for each key from the sketches of its parts; equal hashes meet before ranking."""
    hashes = df.select(key, F.explode(sketch_col).alias("__h")).distinct()
    ranked = hashes.withColumn(
        "__r",
        F.row_number().over(Window.partitionBy(key).orderBy("__h")),
    ).where(F.col("__r") <= k)
    merged = ranked.groupBy(key).agg(F.sort_array(F.collect_list("__h")).alias(sketch_col))
    return df.select(key).distinct().join(
        merged.withColumnRenamed(key, "__key"),
        F.col(key).eqNullSafe(F.col("__key")),
        "left",
    ).select(key, F.coalesce(sketch_col, F.array().cast("array<bigint>")).alias(sketch_col))


def with_next(df: DataFrame, order: str, text: str, derived: dict[str, Column], parts: int) -> DataFrame:
    """Add the derived columns of text, and next_<c> for text and each of them: its value in the row that follows by order
    descending (nulls last) and hash of text; the last row is followed by the first.

    Rows are dealt to parts by range of (order, hash), so that rows which share one order value are split as others are.
    Columns of df that are named as the operator's own are dropped. To each part the first row of the following one is added, so a window over the part finds every successor and no task holds the
    whole order. Columns are derived once, after rows and guests are together.
    """
    # Ascending in both: the complement of a number turns its order round and can't overflow.
    df = df.drop("__key", "__part", "__guest", *derived, *(f"next_{c}" for c in (text, *derived)))
    keyed = df.withColumn(
        "__key",
        F.struct(
            F.col(order).isNull().alias("none"),
            F.bitwise_not(F.coalesce(order, F.lit(0).cast("long"))).alias("place"),
            F.xxhash64(text).alias("tie"),
        ),
    )
    ranges = keyed.select("__key").repartitionByRange(parts, "__key").groupBy(F.spark_partition_id()).agg(
        F.min("__key").alias("k"),
    ) if parts > 1 else None
    bounds = sorted(tuple(r.k) for r in ranges.collect())[1:] if ranges is not None else []  # one row for each part
    literal = lambda k: F.struct(F.lit(k[0]).alias("none"), F.lit(k[1]).cast("long").alias("place"), F.lit(k[2]).cast("long").alias("tie"))
    at = F.lit(0)
    if bounds:
        # In two steps, so that a row is compared with few bounds: first with every step-th, then with those that follow.
        step = math.isqrt(len(bounds)) + 1
        passed = lambda some: F.size(F.filter(some, lambda b: b <= F.col("__key")))
        every = F.array(*(literal(k) for k in bounds))
        coarse = passed(F.array(*(literal(k) for k in bounds[::step])))
        at = let(coarse, lambda c: F.when(c == 0, 0).otherwise((c - 1) * step + passed(F.slice(every, (c - 1) * step + 1, step))))
    dealt = keyed.withColumn("__part", at)
    firsts = dealt.groupBy("__part").agg(F.min_by(F.struct(text), "__key").alias("__first"))
    # At most one row for each part: the part before it takes it in.
    parts_in_order = Window.orderBy("__part")
    before = firsts.select(
        F.coalesce(
            F.lag("__part").over(parts_in_order),
            F.max("__part").over(parts_in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        ).alias("__part"),
        "__first",
    )
    guests = before.select("__part", F.lit(1).alias("__guest"), F.col(f"__first.{text}").alias(text))
    together = dealt.withColumn("__guest", F.lit(0)).unionByName(
        guests,
        allowMissingColumns=True,
    ).withColumns(derived)
    window = Window.partitionBy("__part").orderBy("__guest", "__key")
    return together.select(
        "*",
        *(F.lead(c).over(window).alias(f"next_{c}") for c in (text, *derived)),
    ).where("__guest = 0").drop("__guest", "__part", "__key")


def fingerprint_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """doc_id, text (null as empty), n_chars and sketch of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        text.alias("text"),
        F.length(text).cast("long").alias("n_chars"),
        sketch(text, k).alias("sketch"),
    )
