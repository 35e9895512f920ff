"""How well features tell labels apart, each label against the rest, from one table of value counts.

Entries have keys, label, feature_id and value, one row for each that isn't zero; sizes have keys, label and n, the number
of samples. Counts of distinct values by feature and label, zeros included, are made once; every measure follows from
running totals over a feature's values less the label's own, so entries are never repeated for each label. The
distribution function of the rest changes between a label's own values too, but furthest from the label's at or just
before one of these, so its own values are enough. Two arms are two labels.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MEASURES = ("hist_dist", "delta_mu", "ks_stat", "auc")


def value_counts(entries: DataFrame, sizes: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """(keys, feature_id, label, value, n) for every feature with entries and every label with samples; what is absent is 0."""
    by = [*keys, "feature_id"]
    counts = entries.groupBy(*by, label, F.col("value").cast("double").alias("value")).agg(F.count("*").alias("n"))
    pairs = F.map_from_entries(F.collect_list(F.struct(label, "n")))
    active = counts.groupBy(*by, label).agg(F.sum("n").alias("n")).groupBy(*by).agg(pairs.alias("__active"))
    labels = sizes.groupBy(*keys).agg(F.collect_list(F.struct(label, "n")).alias("__labels"))  # labels are few
    both = active.join(labels, keys) if keys else active.crossJoin(F.broadcast(labels))
    silent = both.select(*by, "__active", F.explode("__labels").alias("__l")).select(
        *by,
        F.col(f"__l.{label}").alias(label),
        F.lit(0.0).alias("value"),
        (F.col("__l.n") - F.coalesce(F.col("__active")[F.col(f"__l.{label}")], F.lit(0))).alias("n"),
    )
    return counts.unionByName(silent.where("n > 0"))


def separability(
    entries: DataFrame,
    sizes: DataFrame,
    keys: list[str],
    label: str = "label",
    measures: tuple[str, ...] = MEASURES,
    bins: int = 20,
) -> DataFrame:
    """(keys, label, feature_id) and the measures wanted, null where the rest is empty.

    hist_dist is 1 less the overlap of histograms over equal bins of the feature's range (last bin closed), 0 for ranges
    below 1e-8; delta_mu the difference of means in size; ks_stat the largest difference of distribution functions; auc
    the chance that the label's sample has the higher value, ties counting half.
    """
    by = [*keys, "feature_id"]
    counts = value_counts(entries, sizes, keys, label)
    all_of, own = Window.partitionBy(*by), Window.partitionBy(*by, label)
    up_to = (Window.unboundedPreceding, Window.currentRow)
    n = F.col("n")
    rows = counts.withColumns({
        "__all": F.sum("n").over(all_of),
        "__here": F.sum("n").over(Window.partitionBy(*by, "value")),
        "__below": F.sum("n").over(all_of.orderBy("value").rangeBetween(*up_to)),
        "__sum": F.sum(n * F.col("value")).over(all_of),
        "__lo": F.min("value").over(all_of),
        "__hi": F.max("value").over(all_of),
    }).withColumns({"__n": F.sum("n").over(own), "__own": F.sum("n").over(own.orderBy("value").rowsBetween(*up_to))})
    # Samples of the rest below a value, and at it.
    under, at = F.col("__below") - F.col("__here") - F.col("__own") + n, F.col("__here") - n
    rest = F.col("__all") - F.col("__n")
    apart = lambda mine, others: F.abs(F.try_divide(mine, F.col("__n")) - F.try_divide(others, rest))
    sums = {
        "delta_mu": {"__s": F.sum(n * F.col("value")), "__t": F.first("__sum")},
        "ks_stat": {"__k": F.max(F.greatest(apart(F.col("__own"), under + at), apart(F.col("__own") - n, under)))},
        "auc": {"__w": F.sum(n * (under + at / 2))},
    }
    used = {c: e for m in measures if m in sums for c, e in sums[m].items()}
    size = {"__n": F.first("__n"), "__all": F.first("__all")}
    if "hist_dist" in measures:
        width = F.col("__hi") - F.col("__lo")
        place = F.when(width < 1e-8, F.lit(0)).otherwise(F.least(F.floor((F.col("value") - F.col("__lo")) / width * bins), F.lit(bins - 1)))
        rows = rows.withColumn("__bin", place).withColumn("__in", F.sum("n").over(Window.partitionBy(*by, "__bin")))
        parts = {"__c": F.sum("n"), "__in": F.first("__in"), **size, **used}
        rows = rows.groupBy(*by, label, "__bin").agg(*(e.alias(c) for c, e in parts.items()))
        shared = F.least(F.try_divide(F.col("__c"), F.col("__n")), F.try_divide(F.col("__in") - F.col("__c"), rest))
        again = {"__s": F.sum("__s"), "__t": F.first("__t"), "__k": F.max("__k"), "__w": F.sum("__w")}
        used = {"__h": F.when(F.first(rest) > 0, 1 - F.sum(shared)), **{c: again[c] for c in used}}
    out = rows.groupBy(*by, label).agg(*(e.alias(c) for c, e in (size | used).items()))
    values: dict[str, Column] = {
        "hist_dist": F.col("__h"),
        "delta_mu": apart(F.col("__s"), F.col("__t") - F.col("__s")),
        "ks_stat": F.col("__k"),
        "auc": F.try_divide(F.col("__w"), F.col("__n") * rest),
    } if used else {}
    return out.select(*keys, label, "feature_id", *(values[m].alias(m) for m in measures))


EULER = 0.5772156649015329
#: The digamma function of 1 to 16.
SMALL_DIGAMMA = [-EULER, *(x - EULER for x in accumulate(1 / i for i in range(1, 16)))]


def digamma(n: Column) -> Column:
    """The digamma function of a whole number from 1 on."""
    x = n.cast("double")
    series = F.log(x) - 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x**4) - 1 / (252 * x**6) + 1 / (240 * x**8)
    return F.when(n > 16, series).otherwise(F.get(F.array(*map(F.lit, SMALL_DIGAMMA)), n.cast("int") - 1))


def neighbour_information(entries: DataFrame, sizes: DataFrame, keys: list[str], label: str = "label", k: int = 3) -> DataFrame:
    """(keys, label, feature_id, mi): mutual information, in nats and never below 0, of a feature's value and whether a
    sample has the label, by nearest neighbours in one dimension.

    For each sample the distance to its k-th nearest of the same side (of fewer, the farthest), and the samples of both
    sides that are nearer than that, itself included; where the distance is 0, those of equal value, so zeros are ties.
    Samples that are alone on their side don't count. Work is on distinct values with their counts: a value's neighbours
    are among k values on each side of it, and how many samples lie within a distance is the difference of two running
    totals, at positions that are sorted in among the values.
    """
    by, n = [*keys, "feature_id"], F.col("n")
    counts = value_counts(entries, sizes, keys, label)
    own = F.map_from_entries(F.collect_list(F.struct(label, "n")))  # labels are few
    values = counts.groupBy(*by, "value").agg(own.alias("__own"), F.sum("n").alias("__all"))
    labels = sizes.where("n > 0").groupBy(*keys).agg(F.collect_list(label).alias("__labels"))
    both = (values.join(labels, keys) if keys else values.crossJoin(F.broadcast(labels))).withColumn(label, F.explode("__labels"))
    mine = F.coalesce(F.col("__own")[F.col(label)], F.lit(0))
    sides = F.array(F.struct(F.lit(True).alias("side"), mine.alias("n")), F.struct(F.lit(False).alias("side"), (F.col("__all") - mine).alias("n")))
    by = [*by, label]
    rows = both.select(*by, "value", "__all", F.explode(sides).alias("s")).select(*by, "value", "__all", "s.side", "s.n").where("n > 0")
    w = Window.partitionBy(*by, "side")
    at = w.orderBy("value")
    pair = F.struct("value", "n")
    near = F.array_compact(F.array(*(f(pair, i).over(at) for i in range(1, k + 1) for f in (F.lag, F.lead))))
    ranked = rows.withColumn("__side", F.sum("n").over(w)).withColumn("__k", F.least(F.lit(k), F.col("__side") - 1)).withColumn("__near", near).where("__side > 1")
    # The distance within which the k-th neighbour lies; equal values come first.
    steps = F.array_sort(F.transform("__near", lambda x: F.struct(F.abs(x.value - F.col("value")).alias("d"), x.n.alias("n"))))
    start = F.struct((n - 1).alias("seen"), F.when(n - 1 >= F.col("__k"), F.lit(0.0)).alias("d"))
    found = F.aggregate(
        steps,
        start,
        lambda a, x: F.struct((a.seen + x.n).alias("seen"), F.coalesce(a.d, F.when(a.seen + x.n >= F.col("__k"), x.d)).alias("d")),
        lambda a: a.d,
    )
    v, r = F.col("value"), F.col("__r")
    # The ends are values where a neighbour lies there, so that rounding moves none across.
    border = F.transform(F.filter("__near", lambda x: F.abs(x.value - v) == r), lambda x: x.value)
    low = F.coalesce(F.array_min(F.filter(border, lambda x: x < v)), v - r)
    high = F.coalesce(F.array_max(F.filter(border, lambda x: x > v)), v + r)
    spans = ranked.withColumn("__r", found).withColumns({"__low": low, "__high": high})
    # Totals up to the lower end (included) and below the upper one, found by sorting ends in among the values.
    query = F.array(
        F.struct(F.col("__low").alias("p"), F.lit(1).alias("o"), F.lit(0).cast("long").alias("w"), F.lit(-1).alias("sign")),
        F.struct(F.col("__high").alias("p"), F.lit(-1).alias("o"), F.lit(0).cast("long").alias("w"), F.lit(1).alias("sign")),
    )
    ends = spans.where("__r > 0").select(*by, "side", "value", F.explode(query).alias("q")).select(*by, "side", "value", "q.*")
    points = rows.select(*by, "side", "value", v.alias("p"), F.lit(0).alias("o"), n.cast("long").alias("w"), F.lit(0).alias("sign"))
    order = Window.partitionBy(*by).orderBy(F.struct("p", "o")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    within = points.unionByName(ends).withColumn("__t", F.sum("w").over(order)).where("sign != 0").groupBy(*by, "side", "value").agg(
        F.sum(F.col("__t") * F.col("sign")).alias("__m"),
    )
    counted = spans.join(within, [*by, "side", "value"], "left").withColumn("__m", F.coalesce("__m", "__all"))
    mean = lambda c: F.sum(n * digamma(c)) / F.sum("n")
    out = counted.groupBy(*by).agg(
        (digamma(F.sum("n")) + mean(F.col("__k")) - mean(F.col("__side")) - mean(F.col("__m"))).alias("mi"),
    )
    return out.select(*keys, label, "feature_id", F.greatest(F.lit(0.0), "mi").alias("mi"))


def feature_freq(entries: DataFrame, sizes: DataFrame, keys: list[str], label: str = "label", threshold: float = 0.0) -> DataFrame:
    """Share of samples above threshold and mean of those entries, for the label (unsafe) and for the rest (safe), and the
    mean over all samples."""
    by = [*keys, "feature_id"]
    on = F.col("value") > threshold
    mine = value_counts(entries, sizes, keys, label).groupBy(*by, label).agg(
        F.sum("n").alias("size"),
        F.sum(F.when(on, F.col("n")).otherwise(0)).alias("k"),
        F.sum(F.when(on, F.col("n") * F.col("value")).otherwise(0.0)).alias("s"),
        F.sum(F.col("n") * F.col("value")).alias("t"),
    )
    w = Window.partitionBy(*by)
    every = mine.withColumns({f"all_{c}": F.sum(c).over(w) for c in ("size", "k", "s", "t")})
    other = lambda c: F.col(f"all_{c}") - F.col(c)
    return every.select(
        *keys,
        label,
        "feature_id",
        F.try_divide("k", "size").alias("freq_unsafe"),
        F.try_divide(other("k"), other("size")).alias("freq_safe"),
        F.try_divide("s", "k").alias("magnitude_unsafe"),
        F.try_divide(other("s"), other("k")).alias("magnitude_safe"),
        F.try_divide("all_t", "all_size").alias("mean"),
    )


def rank_features(
    scores: DataFrame,
    keys: list[str],
    weights: tuple[float, float, float] = (0.4, 0.4, 0.2),
    preselect: int = 500,
    keep: int = 200,
) -> DataFrame:
    """The best features by a weighted sum of histogram distance, mean difference and KS, where only the best by the first
    two are considered. scores are those of separability; keys include the label."""
    order = lambda c: Window.partitionBy(*keys).orderBy(F.desc(c), F.asc("feature_id"))
    partial = scores.withColumn("partial", weights[0] * F.col("hist_dist") + weights[1] * F.col("delta_mu"))
    best = partial.withColumn("__r", F.row_number().over(order("partial"))).where(F.col("__r") <= preselect)
    scored = best.withColumn("score", F.col("partial") + weights[2] * F.coalesce("ks_stat", F.lit(0.0)))
    return scored.withColumn("rank", F.row_number().over(order("score"))).where(F.col("rank") <= keep).drop("partial", "__r")


def repair_proxy(entries: DataFrame, sizes: DataFrame, keys: list[str], groups: DataFrame, label: str = "label") -> DataFrame:
    """For each group (group_id, keys, label, feature_ids) the mean share of the label's samples above the mean and sample
    deviation of the rest; features without entries count 0."""
    by = [*keys, "feature_id"]
    members = groups.select("group_id", *keys, label, F.explode("feature_ids").alias("feature_id"))
    own = entries.join(members.select(*by).distinct(), by, "left_semi")
    v, n = F.col("value"), F.col("n")
    w, mine = Window.partitionBy(*by), Window.partitionBy(*by, label)
    totals = {"n": n, "s1": n * v, "s2": n * v * v}
    rows = value_counts(own, sizes, keys, label).withColumns(
        {f"__{c}": F.sum(x).over(w) - F.sum(x).over(mine) for c, x in totals.items()},
    )
    mean = F.try_divide("__s1", "__n")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("__s2") - F.col("__n") * mean * mean, F.col("__n") - 1)))
    shares = rows.groupBy(*by, label).agg(
        F.try_divide(F.sum(F.when(v > mean + spread, n).otherwise(0)), F.sum("n")).alias("share"),
    )
    return members.join(shares, [*by, label], "left").groupBy("group_id").agg(
        F.avg(F.coalesce("share", F.lit(0.0))).alias("repair_proxy"),
    )
