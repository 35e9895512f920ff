"""Paired statistics: intervals, exact tests, bootstraps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlab.functions.text import column
from pairlab.operators.sampling import tree_totals
from pairlab.sources.io import cut

Z = 1.959963984540054


def wilson(k: Column | str, n: Column | str, z: float = Z) -> tuple[Column, Column]:
    """The bounds of the Wilson interval of k successes out of n; null for n = 0."""
    k, n = column(k).cast("double"), column(n).cast("double")
    p, d = F.try_divide(k, n), F.try_divide(F.lit(z * z), n)
    middle = (p + d / 2) / (1 + d)
    half = F.lit(z) * F.sqrt(F.try_divide(p * (1 - p), n) + d / n / 4) / (1 + d)
    return middle - half, middle + half


def mcnemar_exact(b: Column | str, c: Column | str) -> Column:
    """The exact two-sided p of b against c discordant pairs: 1 if there are none."""
    low, n = F.least(column(b), column(c)).cast("int"), (column(b) + column(c)).cast("int")
    # log C(n, i) grows from i to i + 1 by log((n - i) / (i + 1)); terms are summed at 2**-n.
    start = F.struct((-n * F.lit(math.log(2))).cast("double").alias("term"), F.lit(0.0).alias("total"))
    step = lambda a, i: F.struct((a.term + F.log((n - i) / (i + 1))).alias("term"), (a.total + F.exp(a.term)).alias("total"))
    tail = F.aggregate(F.sequence(F.lit(0), low), start, step, lambda a: a.total)
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


def holm(df: DataFrame, p: str, family: list[str]) -> DataFrame:
    """Add p_holm, the step-down adjusted p within each family."""
    w = Window.partitionBy(*family)
    ranked = df.withColumns({"__r": F.row_number().over(w.orderBy(p)), "__m": F.count("*").over(w)})
    raw = F.least(F.lit(1.0), (F.col("__m") - F.col("__r") + 1) * F.col(p))
    return ranked.withColumn("p_holm", F.max(raw).over(w.orderBy("__r"))).drop("__r", "__m")


def percentile7(col: Column | str, p: float) -> Column:
    """The exact percentile with linear interpolation, as an aggregate that holds a group's distinct values in one task; for
    groups without a bound see quantiles.exact_percentiles."""
    return F.percentile(col, F.lit(p))


def utility_deltas(df: DataFrame, keys: list[str], base: str, thresholds: DataFrame) -> DataFrame:
    """Each condition against the base condition on the same tasks: rates, their difference, improved and regressed
    tasks, and whether the drop is below the threshold. df has keys, condition, task_id, passed."""
    other = df.where(F.col("condition") == base).select(*keys, "task_id", F.col("passed").alias("base_passed"))
    both = df.where(F.col("condition") != base).join(other, [*keys, "task_id"])
    counted = both.groupBy(*keys, "condition").agg(
        F.count("*").alias("n"),
        F.avg(F.col("base_passed").cast("int")).alias("base_rate"),
        F.avg(F.col("passed").cast("int")).alias("rate"),
        F.count_if(F.expr("passed AND NOT base_passed")).alias("improved"),
        F.count_if(F.expr("base_passed AND NOT passed")).alias("regressed"),
    )
    limit = counted.join(thresholds, keys, "left").withColumn("delta", F.col("rate") - F.col("base_rate"))
    return limit.withColumn(
        "status",
        F.when(-F.col("delta") >= F.col("threshold"), "DROP_EXCEEDS_THRESHOLD").otherwise("WITHIN_THRESHOLD"),
    )


def patterns(df: DataFrame, unit: list[str], values: list[Column]) -> DataFrame:
    """Units collapsed to distinct vectors of values: (v array<double>, n). Resampling units means resampling these."""
    vector = df.select(
        F.array(*(v.cast("double") for v in values)).alias("v"),
    ) if not unit else df.groupBy(*unit).agg(F.array(*(F.sum(v.cast("double")) for v in values)).alias("v"))
    return vector.groupBy("v").agg(F.count("*").alias("n"))


#: Draws that share the coefficients of a polynomial, and the prime it is taken modulo (both fixed, so that SQL can follow).
DRAWS = 1 << 16
PRIME = (1 << 31) - 1
#: Ranges of positions by which draws meet patterns.
PLACES = 4096
#: Numbers in the patterns' table up to which it is sent to all tasks (16 MB).
FEW_VALUES = 2_000_000


def drawn_positions(size: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(replicate, units, position): as many positions below units as there are units, for each replicate. size has one row.

    Positions are values of cubic polynomials modulo a prime, whose coefficients are hashes of seed, replicate and block of
    draws: any four draws of a block are independent, and each costs a few integer operations.
    """
    p = F.lit(PRIME)
    blocks = F.sequence(F.lit(0), F.expr("(units - 1) DIV " + str(DRAWS)))
    each = size.sparkSession.range(replicates).withColumnRenamed("id", "replicate").crossJoin(F.broadcast(size)).where("units > 0")
    each = each.select("replicate", "units", F.explode(blocks).alias("block"))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("replicate").cast("string"), F.col("block").cast("string")))
    parts = {f"c{k}": F.conv(F.substring(key, 8 * k + 1, 8), 16, 10).cast("long") % p for k in range(4)}
    count = F.least(F.lit(DRAWS), F.col("units") - F.col("block") * DRAWS)
    draws = each.select("replicate", "units", *(c.alias(n) for n, c in parts.items()), count.alias("m")).select(
        "replicate",
        "units",
        *parts,
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("i"),
    )
    value = F.lit(0).cast("long")
    for c in parts:
        value = (value * F.col("i") + F.col(c)) % p
    return draws.select("replicate", "units", value.alias("h")).select("replicate", "units", F.expr(f"h * units DIV {PRIME}").alias("position"))


def resampled_sums(table: DataFrame, width: int, replicates: int, seed: int, held: int = 100_000) -> DataFrame:
    """(replicate, sums array<double>, n): sums of the pattern vectors (of width values) over as many units drawn with
    replacement as there are; fewer than 2**31.

    Patterns lie one after another, in the order of a hash of their values, each as long as its number of units. A draw is
    a hashed position, and a range join finds its pattern. Draws are made, met with patterns and summed where they are
    made, so what is shuffled is a row for each replicate and task.
    """
    table = cut(table, "patterns")
    text = F.concat_ws("|", F.transform("v", lambda x: x.cast("string")))
    placed = tree_totals(table.withColumn("__h", F.md5(text)), [], ["__h"], "n", held).select(
        "v",
        (F.col("__r") - F.col("n")).alias("low"),
        (F.col("__r") - 1).alias("high"),
    )
    size = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("units"))
    step = lambda units: F.greatest(F.lit(1), F.expr(f"{units} DIV {PLACES}"))
    # A pattern has a row in each range of positions that it reaches into.
    ranges = placed.crossJoin(F.broadcast(size)).withColumn("step", step("units")).select(
        *(F.col("v")[i].alias(f"x{i}") for i in range(width)),
        "low",
        "high",
        F.explode(F.sequence(F.expr("low DIV step"), F.expr("high DIV step"))).alias("place"),
    )
    draws = drawn_positions(size, replicates, seed).withColumn("step", step("units")).withColumn("place", F.expr("position DIV step"))
    # Spark can't tell how many rows draws are, so it is told: patterns go to all tasks if they are few, else both meet by place.
    few = (table.count() + PLACES) * (width + 4) <= FEW_VALUES
    met = draws.join(F.broadcast(ranges) if few else ranges.hint("merge"), "place").where("position BETWEEN low AND high")
    sums = met.groupBy("replicate").agg(*(F.sum(f"x{i}").alias(f"x{i}") for i in range(width)), F.count("*").alias("n"))
    return sums.select("replicate", F.array(*(f"x{i}" for i in range(width))).alias("sums"), "n")


def interval(replicates: DataFrame, contrasts: dict[str, Column], level: float = 0.95) -> DataFrame:
    """(contrast, low, high, n): percentile bounds of each contrast over the replicates in which it has a value. A group is
    as large as the number of replicates, a parameter, and so may be held."""
    tail = (1 - level) / 2
    pairs = F.explode(
        F.array(*(F.struct(F.lit(n).alias("contrast"), c.cast("double").alias("x")) for n, c in contrasts.items())),
    )
    return replicates.select(pairs.alias("p")).select("p.*").groupBy("contrast").agg(
        percentile7("x", tail).alias("low"),
        percentile7("x", 1 - tail).alias("high"),
        F.count("x").alias("n"),
    )


def paired_bootstrap(df: DataFrame, a: Column, b: Column, replicates: int = 10_000, seed: int = 42) -> DataFrame:
    """Interval of the difference of two success rates over the same units."""
    sums = resampled_sums(patterns(df, [], [a, b]), 2, replicates, seed)
    return interval(sums, {"difference": (F.col("sums")[0] - F.col("sums")[1]) / F.col("n")})


def ratio_bootstrap(
    df: DataFrame,
    unit: list[str],
    conditions: list[tuple[str, Column, Column]],
    contrasts: dict[str, tuple[list[str], list[str]]],
    replicates: int = 10_000,
    seed: int = 42,
) -> DataFrame:
    """Intervals of contrasts between means of ratios, where one resample of units drives all conditions.

    conditions are (name, numerator, denominator) per row; a contrast is the mean ratio of its first names less that of
    its second ones (which may be none). Replicates in which a denominator is 0 have no value.
    """
    at = {name: 2 * i for i, (name, _, _) in enumerate(conditions)}
    values = [x for _, n, d in conditions for x in (n, d)]
    sums = resampled_sums(patterns(df, unit, values), len(values), replicates, seed)
    ratio = lambda name: F.try_divide(F.col("sums")[at[name]], F.col("sums")[at[name] + 1])
    mean = lambda names: sum((ratio(n) for n in names), F.lit(0.0)) / len(names) if names else F.lit(0.0)
    return interval(sums, {k: mean(x) - mean(y) for k, (x, y) in contrasts.items()})


def cluster_bootstrap(
    df: DataFrame,
    cluster: list[str],
    numerator: Column,
    denominator: Column,
    replicates: int = 10_000,
    seed: int = 42,
) -> DataFrame:
    """Interval of a ratio when whole clusters are drawn."""
    return ratio_bootstrap(df, cluster, [("r", numerator, denominator)], {"ratio": (["r"], [])}, replicates, seed)


def hashed_bootstrap(
    units: DataFrame,
    order: str,
    draws: int,
    values: list[str],
    replicates: int,
    seed: int,
) -> DataFrame:
    """(replicate, sum of each value) where draw i of replicate r is the unit whose place by order is a hash of (seed, r, i)
    modulo their number. A small exact variant that SQL can repeat; units are few and numbered in one task."""
    placed = units.withColumn("__k", F.row_number().over(Window.orderBy(order)) - 1)
    size = units.agg(F.count("*").alias("__n"))
    drawn = units.sparkSession.range(replicates).select(
        F.col("id").alias("replicate"),
        F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("i"),
    )
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("replicate").cast("string"), F.col("i").cast("string")))
    pick = drawn.crossJoin(F.broadcast(size)).select(
        "replicate",
        (F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % F.col("__n")).cast("int").alias("__k"),
    )
    return pick.join(F.broadcast(placed), "__k").groupBy("replicate").agg(*(F.sum(v).alias(v) for v in values))


def admissible(df: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """Add admissible and, as text, the gates that failed."""
    failed = F.concat_ws("; ", *(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in gates.items()))
    return df.withColumn("reason", failed).withColumn("admissible", F.col("reason") == "")


def select_best(df: DataFrame, keys: list[str], order: list[tuple[str, bool]], gate: Column) -> DataFrame:
    """Rank rows that pass the gate by the columns of order (name, ascending); add rank, selected and, for the others,
    the first column in which they lose to the winner. Rows that fail the gate have neither."""
    by = [F.asc(c) if up else F.desc(c) for c, up in order]
    ranked = df.withColumn("__g", gate).withColumn(
        "selection_rank",
        F.when(F.col("__g"), F.row_number().over(Window.partitionBy(*keys, "__g").orderBy(*by))),
    )
    first = F.first(F.struct(*(c for c, _ in order))).over(
        Window.partitionBy(*keys, "__g").orderBy(*by).rowsBetween(
            Window.unboundedPreceding,
            Window.unboundedFollowing,
        ),
    )
    marked = ranked.withColumn("__w", first).withColumn(
        "selected",
        F.coalesce(F.col("selection_rank") == 1, F.lit(False)),
    )
    loses = F.coalesce(*(F.when(~F.col(c).eqNullSafe(F.col("__w")[c]), F.lit(c)) for c, _ in order))
    return marked.withColumn("losing_field", F.when(F.col("selection_rank") > 1, loses)).drop("__w", "__g")
