"""Exact percentiles of groups of any size, by narrowing ranges of values down to the wanted ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlab.sources.io import cut

#: Steps of the first ranges for each unit of the natural logarithm, and ranges a later pass splits one into.
STEPS = 22
SPLITS = 4096


def coarse_place(v: Column) -> Column:
    """A whole number that never falls as v grows: by sign and logarithm, zero, infinities and NaN (last) apart."""
    scale = F.signum(v) * (F.log(F.abs(v)) + 746)  # the logarithm of the least number is above -745
    bounded = F.greatest(F.lit(-1550.0), F.least(F.lit(1550.0), scale))
    return F.when(F.isnan(v), F.lit(1600 * STEPS)).when(v == 0, F.lit(0)).otherwise(F.floor(bounded * STEPS)).cast("int")


def _ranks(total: Column, p: float) -> tuple[Column, Column, Column]:
    """The places (from 0) between which percentile p lies, and how far it is from the first."""
    at = (total - 1) * F.lit(float(p))
    low = F.floor(at)
    return low, F.ceil(at), at - low


def exact_percentiles(df: DataFrame, keys: list[str], value: Column | str, wanted: dict[str, float], held: int = 10_000) -> DataFrame:
    """keys and a column for each name in wanted: the type-7 percentile (linear interpolation) of the group's values.

    The first pass counts values in ranges of their logarithm; each further pass splits the ranges that hold a wanted rank
    into SPLITS even parts, until they hold one value or at most `held` rows, which are then sorted. A range of the first
    pass spans less than 5 % of its size, that is 2**52 numbers at most, and a pass divides that by SPLITS, so there are
    at most five. Every pass reads the rows once and shuffles counts alone; no task holds or sorts a group. Nulls don't
    count, and a group without values has no row; NaN is greater than all numbers.
    """
    by = [f"__k{i}" for i in range(len(keys))] or ["__k"]
    named = [F.col(k).alias(b) for k, b in zip(keys, by, strict=False)] or [F.lit(0).alias("__k")]
    v = F.col("v")
    values = df.select(*named, (F.col(value) if isinstance(value, str) else value).cast("double").alias("v")).where("v IS NOT NULL")
    same = lambda a, b, cols: [a[c].eqNullSafe(b[c]) for c in cols]
    counts = [F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")]

    # Ranges with the rows before them; those that hold a wanted rank stay, once for each such rank.
    first = values.groupBy(*by, coarse_place(v).alias("place")).agg(*counts)
    earlier = Window.partitionBy(*by).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = first.withColumns({"before": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "total": F.sum("n").over(Window.partitionBy(*by))})
    ranks = F.array_distinct(F.array(*(r for p in wanted.values() for r in _ranks(F.col("total"), p)[:2])))
    inside = F.filter(ranks, lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n")))
    fields = [*by, "total", "rank", "lo", "hi", "n", "before"]
    targets = cut(placed.withColumn("rank", F.explode(inside)).select(*fields), "percentile")

    wide = (F.col("lo") < F.col("hi")) & (F.col("n") > held)
    while not targets.where(wide).isEmpty():
        spans = targets.where(wide).select(*by, "lo", "hi").distinct().alias("s")
        rows = values.alias("r").join(spans, [*same(values.alias("r"), spans, by), v.between(F.col("s.lo"), F.col("s.hi"))])
        part = F.least(F.floor((v - F.col("s.lo")) / (F.col("s.hi") - F.col("s.lo")) * SPLITS), F.lit(SPLITS - 1))
        split = rows.groupBy(*(F.col(f"s.{b}").alias(b) for b in by), F.col("s.lo").alias("slo"), F.col("s.hi").alias("shi"), part.alias("part")).agg(*counts)
        over = Window.partitionBy(*by, "slo", "shi").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        split = split.withColumn("earlier", F.coalesce(F.sum("n").over(over), F.lit(0))).alias("p")
        now = targets.where(wide).alias("t")
        hit = [*same(now, split, by), F.col("t.lo") == F.col("p.slo"), F.col("t.hi") == F.col("p.shi")]
        before = F.col("t.before") + F.col("p.earlier")
        hit += [F.col("t.rank") >= before, F.col("t.rank") < before + F.col("p.n")]
        finer = now.join(split, hit).select(*(F.col(f"t.{c}").alias(c) for c in (*by, "total", "rank")), "p.lo", "p.hi", "p.n", before.alias("before"))
        targets = cut(targets.where(~wide).unionByName(finer), "percentile")

    # What is left of a range is sorted.
    spans = targets.where("lo < hi").select(*by, "lo", "hi", "before").distinct().alias("s")
    rows = values.alias("r").join(spans, [*same(values.alias("r"), spans, by), v.between(F.col("s.lo"), F.col("s.hi"))])
    order = Window.partitionBy(*(F.col(f"s.{b}") for b in by), "s.lo").orderBy("v")
    sorted_rows = rows.select(*(F.col(f"s.{b}").alias(b) for b in by), "v", (F.col("s.before") + F.row_number().over(order) - 1).alias("rank")).alias("o")
    kept = targets.where("lo < hi").alias("t")
    found = kept.join(sorted_rows, [*same(kept, sorted_rows, by), F.col("t.rank") == F.col("o.rank")])
    every = targets.where("NOT lo < hi").select(*by, "total", "rank", F.col("lo").alias("v")).unionByName(
        found.select(*(F.col(f"t.{c}").alias(c) for c in (*by, "total", "rank")), "o.v"),
    )
    at = every.groupBy(*by, "total").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))

    def between(p: float) -> Column:
        low, high, part = _ranks(F.col("total"), p)
        a, b = F.col("at")[low], F.col("at")[high]
        return F.when(a == b, a).otherwise(a + (b - a) * part)

    return at.select(*(F.col(b).alias(k) for k, b in zip(keys, by, strict=False)), *(between(p).alias(name) for name, p in wanted.items()))
