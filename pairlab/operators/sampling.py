"""Samples and splits, all deterministic: rows are taken in the order of a hash of seed and key."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(seed: int, key: Column | str) -> Column:
    """The text by which rows are ordered: md5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}|"), (F.col(key) if isinstance(key, str) else key).cast("string")))


#: Rows that one task numbers, about; beyond it a group is dealt into more buckets.
HELD = 100_000
#: Hexadecimal digits of a level of the bucket tree; with two levels a group can have 16**8 buckets.
LEVEL = 4


def tree_totals(df: DataFrame, keys: list[str], order: list[str], weight: str | None = None, held: int = HELD) -> DataFrame:
    """Add __r, the running total of weight (or of rows) in the row's group by the columns of order, its own included; the
    first column of order is a hexadecimal hash.

    A group is split by as many digits of the hash as it takes to have about `held` rows in a bucket, or fewer: none for a
    small group. Buckets are summed by themselves and moved by what lies before them, which is summed as a tree: earlier
    buckets with the same first digits, and groups of buckets with lower first digits. So no task sorts a group or sums up
    all its buckets. Rows that repeat a hash share a bucket.
    """
    h, own_weight = order[0], F.col(weight) if weight else F.lit(1)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    digits = F.when(F.col("__n") <= held, F.lit(0)).otherwise(F.ceil(F.log(F.col("__n") / held) / math.log(16)).cast("int"))
    depth = sizes.select(*(F.col(k).alias(f"__{k}") for k in keys), F.least(digits, F.lit(2 * LEVEL)).alias("__d"))
    same = reduce(lambda a, b: a & b, (df[k].eqNullSafe(depth[f"__{k}"]) for k in keys), F.lit(True))
    dealt = (df.join(depth, same) if keys else df.crossJoin(F.broadcast(depth))).drop(*(f"__{k}" for k in keys))
    dealt = dealt.withColumn("__b", F.substring(F.col(h), F.lit(1), F.col("__d"))).drop("__d")
    # Totals of buckets, of their parents, and what lies before each.
    leaves = dealt.groupBy(*keys, "__b").agg(F.sum(own_weight).alias("__n")).withColumn("__p", F.substring("__b", 1, LEVEL))
    earlier = (Window.unboundedPreceding, -1)
    before = lambda by, at: F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy(at).rowsBetween(*earlier)), F.lit(0))
    parents = leaves.groupBy(*keys, "__p").agg(F.sum("__n").alias("__n")).withColumn("__outer", before(keys, "__p"))
    leaves = leaves.withColumn("__inner", before([*keys, "__p"], "__b"))
    own = [leaves[k].eqNullSafe(parents[k]) for k in keys]
    tree = leaves.join(parents, [*own, leaves["__p"] == parents["__p"]]).select(
        *(leaves[k].alias(f"__{k}") for k in keys),
        leaves["__b"].alias("__c"),
        (F.col("__outer") + F.col("__inner")).alias("__before"),
    )
    inside = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = dealt.withColumn("__i", F.sum(own_weight).over(inside))
    at = [ranked[k].eqNullSafe(tree[f"__{k}"]) for k in keys]
    moved = ranked.join(tree, [*at, ranked["__b"] == tree["__c"]])
    return moved.withColumn("__r", F.col("__before") + F.col("__i")).drop("__b", "__c", "__i", "__before", *(f"__{k}" for k in keys))


def global_rank(df: DataFrame, order: str, held: int = HELD) -> DataFrame:
    """Add rank (from 1) by a column of hexadecimal hashes."""
    return tree_totals(df, [], [order], held=held).withColumnRenamed("__r", "rank")


def with_hash(df: DataFrame, ident: str, seed: int) -> DataFrame:
    return df.withColumn("__h", hash_order(seed, ident))


def lowest_hashes(
    df: DataFrame,
    keys: list[str],
    wanted: Column,
    ident: str,
    seed: int,
    order: list[Column] = (),
) -> DataFrame:
    """In each group the rows that come first by order and hash, as many as wanted (a literal, so that Spark can keep the
    first rows of every task only)."""
    ranked = with_hash(df, ident, seed).withColumn(
        "__r",
        F.row_number().over(Window.partitionBy(*keys).orderBy(*order, "__h", ident)),
    )
    return ranked.where(F.col("__r") <= wanted)


def group_rank(df: DataFrame, keys: list[str], ident: str, seed: int, first: Column | None = None, held: int = HELD) -> DataFrame:
    """Add __r, each row's place (from 1) in its group by hash; with first, rows for which it holds come before the others."""
    dealt = with_hash(df, ident, seed)
    if first is None:
        return tree_totals(dealt, keys, ["__h", ident], held=held).drop("__h")
    # Both parts are ranked by themselves, and the second is moved by the size of the first.
    marked = dealt.withColumn("__f", ~F.coalesce(first, F.lit(False)))
    ranked = tree_totals(marked, [*keys, "__f"], ["__h", ident], held=held).drop("__h")
    leading = marked.groupBy(*keys).agg(F.count_if(~F.col("__f")).alias("__lead")).withColumnsRenamed({k: f"__{k}" for k in keys})
    same = [ranked[k].eqNullSafe(leading[f"__{k}"]) for k in keys]
    joined = ranked.join(leading, same) if keys else ranked.crossJoin(F.broadcast(leading))
    return joined.withColumn("__r", F.col("__r") + F.when(F.col("__f"), F.col("__lead")).otherwise(0)).drop("__f", "__lead", *(f"__{k}" for k in keys))


def cap_augmented(df: DataFrame, keys: list[str], augmented: str, ident: str, share: float, seed: int) -> DataFrame:
    """Keep augmented rows up to a share of each group: raw * share / (1 - share); all of them in groups without raw rows."""
    raw = df.groupBy(*keys).agg(F.count_if(~F.col(augmented)).alias("__raw"))
    allowed = F.floor(F.col("__raw") * share / (1 - share))
    ranked = group_rank(df, keys, ident, seed, first=F.col(augmented)).join(raw, keys)
    return ranked.where(~F.col(augmented) | (F.col("__raw") == 0) | (F.col("__r") <= allowed)).drop("__raw", "__r")


def balance_groups(
    df: DataFrame,
    keys: list[str],
    augmented: str,
    ident: str,
    ratio: float,
    seed: int,
    relaxed: float = 3.0,
    treated: Column | None = None,
) -> DataFrame:
    """No group above ratio times the smallest, or above relaxed times where the largest is more than relaxed times the
    smallest; augmented rows go first, then those of highest hash. Only groups for which treated (of the keys) holds are
    counted and cut; the others stay whole."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    own = counts.where(treated) if treated is not None else counts
    used = F.when(F.max("n") > F.min("n") * relaxed, F.lit(float(relaxed))).otherwise(F.lit(float(ratio)))
    limit = own.agg(F.floor(F.min("n") * used).alias("__cap"))
    ranked = group_rank(df, keys, ident, seed, first=~F.col(augmented)).crossJoin(F.broadcast(limit))  # one row
    kept = F.col("__r") <= F.col("__cap")
    return ranked.where(kept if treated is None else kept | ~treated).drop("__cap", "__r")


def split_by_unit(df: DataFrame, unit: str, fractions: tuple[float, float], heldout: Column, seed: int) -> DataFrame:
    """Add split: whole units go to train, validation or test by hash rank; held-out rows go to test whatever their unit."""
    units = df.where(~heldout).select(unit).distinct()
    ranked = global_rank(units.withColumn("__h", hash_order(seed, unit)), "__h")
    n = units.agg(F.count("*").alias("__n"))
    a, b = (F.floor(F.col("__n") * F.lit(f)) for f in (fractions[0], fractions[1]))
    place = F.when(F.col("rank") <= a, "train").when(F.col("rank") <= a + b, "validation").otherwise("test")
    known = ranked.crossJoin(F.broadcast(n)).select(F.col(unit).alias("__u"), place.alias("__s"))
    return df.join(known, F.col(unit) == F.col("__u"), "left").withColumn(
        "split",
        F.when(heldout, "test").otherwise(F.col("__s")),
    ).drop("__u", "__s")


def split_rows(df: DataFrame, ident: str, share: float, seed: int) -> DataFrame:
    """Add split: exactly int(n * share) rows are dev, the rest test."""
    ranked = global_rank(with_hash(df, ident, seed), "__h")
    n = df.agg(F.floor(F.count("*") * F.lit(share)).alias("__k"))
    return ranked.crossJoin(F.broadcast(n)).withColumn(
        "split",
        F.when(F.col("rank") <= F.col("__k"), "dev").otherwise("test"),
    ).drop("__h", "rank", "__k")


def split_counts(df: DataFrame, split: str, category: str) -> DataFrame:
    """(split, category, n, share): rows of each category in each split, and of each split as a whole (category ALL), with
    their share of the split."""
    counts = df.groupingSets([[F.col(split), F.col(category)], [F.col(split)]], F.col(split), F.col(category)).agg(
        F.grouping(category).alias("__g"),
        F.count("*").alias("n"),
    )
    whole = F.max(F.when(F.col("__g") == 1, F.col("n"))).over(Window.partitionBy(split))
    name = F.when(F.col("__g") == 1, "ALL").otherwise(F.col(category).cast("string"))
    return counts.select(F.col(split).alias("split"), name.alias("category"), "n", (F.col("n") / whole).alias("share"))


def hamilton(strata: DataFrame, key: str, size: str, target: int) -> DataFrame:
    """Add quota: target seats dealt in proportion to size, remainders largest first, ties by key. One row per stratum."""
    total = Window.partitionBy()
    exact = F.col(size) * F.lit(target) / F.sum(size).over(total)
    # The remainder is compared as a whole number, free of rounding.
    rest = (F.col(size) * F.lit(target)) % F.sum(size).over(total)
    base = strata.withColumns({"__f": F.floor(exact), "__m": rest})
    ranked = base.withColumn("__r", F.row_number().over(Window.orderBy(F.desc("__m"), F.asc(key)))).withColumn(
        "__left",
        F.lit(target) - F.sum("__f").over(total),
    )
    return ranked.withColumn("quota", F.col("__f") + (F.col("__r") <= F.col("__left")).cast("long")).drop(
        "__f",
        "__m",
        "__r",
        "__left",
    )


def hamilton_capped(strata: DataFrame, key: str, size: str, target: int) -> DataFrame:
    """(key, quota): one seat for each stratum, the others in proportion to size by largest remainder (ties by key), none
    above its size. What full strata can't take goes to the others in the same way, round by round, until none is left;
    there, too, floors are clamped to what a stratum can take. One row per stratum; rounds are few."""
    total = Window.partitionBy()
    n = F.col("__n")
    checked = strata.agg(F.count("*").alias("k"), F.sum(size).alias("s")).first()
    if not checked.k <= target <= (checked.s or 0):
        raise ValueError("the target must be between the number of strata and their sizes' sum")
    out = strata.select(F.col(key), F.col(size).alias("__n"), F.lit(1).cast("long").alias("quota"))
    left, first = target - checked.k, True
    while left > 0:
        free = F.lit(True) if first else F.col("quota") < n
        weight = F.sum(F.when(free, n)).over(total)
        share = F.when(free, F.floor(n * F.lit(left) / weight)).otherwise(0)
        rest = F.when(free, (n * F.lit(left)) % weight)
        add = share if first else F.least(share, n - F.col("quota"))
        dealt = out.withColumns({"__rest": rest, "__new": F.col("quota") + add})
        open_ = F.col("__rest").isNotNull() & (F.lit(first) | (F.col("__new") < n))
        order = Window.partitionBy("__open").orderBy(F.desc("__rest"), F.asc(key))
        spare = F.lit(left) - F.sum(F.col("__new") - F.col("quota")).over(total)
        ranked = dealt.withColumn("__open", open_).withColumns({"__spare": spare, "__r": F.row_number().over(order)})
        seat = (F.col("__open") & (F.col("__r") <= F.col("__spare"))).cast("long")
        out = ranked.select(key, "__n", F.least(n, F.col("__new") + seat).cast("long").alias("quota"))
        left, first = target - out.agg(F.sum("quota")).first()[0], False
    return out.select(key, "quota")


def nested_sample(df: DataFrame, keys: list[str], ident: str, large: int, small: int, seed: int) -> DataFrame:
    """The first `large` rows of each group by hash, of which in_small marks the first `small`."""
    taken = lowest_hashes(df, keys, F.lit(large), ident, seed)
    return taken.withColumn("in_small", F.col("__r") <= small).drop("__h", "__r")


def sample_controls(
    df: DataFrame,
    keys: list[str],
    positive: Column,
    ident: str,
    multiple: int,
    seed: int,
) -> DataFrame:
    """All positives of each group and at most multiple times as many negatives."""
    marked = df.withColumn("__p", positive)
    ranked = group_rank(marked, keys, ident, seed, first=~F.col("__p"))
    counts = marked.groupBy(*keys).agg((F.count_if("__p") * multiple).alias("__most"))
    return ranked.join(counts, keys).where(
        F.col("__p") | (F.col("__r") <= F.col("__most")),
    ).drop("__p", "__r", "__most")


def cap_per_class(df: DataFrame, keys: list[str], ident: str, k: int, seed: int) -> DataFrame:
    """At most k rows of each class."""
    return lowest_hashes(df, keys, F.lit(k), ident, seed).drop("__h", "__r")
