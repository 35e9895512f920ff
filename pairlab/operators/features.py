"""Statistics of features on active entries; measures of separability are in separability.py.

Long tables have one row for each entry that isn't zero: keys (layer, category, ...), arm ('unsafe' or 'safe'),
sample_id, feature_id, value; `sizes` has keys, n_unsafe and n_safe. What is absent is zero, and its mass follows from
the sizes, so zeros are never made into rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlab.operators.quantiles import exact_percentiles
from pairlab.operators.sampling import group_rank


def in_arm(arm: str) -> Column:
    return F.col("arm") == arm


def activation_stats(
    long: DataFrame,
    samples: DataFrame,
    keys: list[str],
    dims: int,
    top: int = 20,
) -> tuple[DataFrame, DataFrame]:
    """Per key: active entries per sample (mean, sample deviation), sparsity, magnitude of active entries and features
    ever active; and the features active most often. samples (keys, sample_id) has all samples, also inactive ones."""
    active = long.groupBy(*keys, "sample_id").agg(F.count("*").alias("a"))
    per = samples.join(active, [*keys, "sample_id"], "left").fillna(0, ["a"]).groupBy(*keys).agg(
        F.count("*").alias("n_samples"),
        F.avg("a").alias("active_mean"),
        F.stddev_samp("a").alias("active_sd"),
        (1 - F.avg("a") / dims).alias("sparsity"),
    )
    size = long.groupBy(*keys).agg(
        F.avg(F.abs("value")).alias("magnitude_mean"),
        F.stddev_samp(F.abs("value")).alias("magnitude_sd"),
        F.max(F.abs("value")).alias("magnitude_max"),
        F.count_distinct("feature_id").alias("features_ever_active"),
    )
    often = long.groupBy(*keys, "feature_id").agg(F.count("*").alias("n_active"))
    ranked = often.withColumn(
        "rank",
        F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n_active"), F.asc("feature_id"))),
    ).where(F.col("rank") <= top)
    return per.join(size, keys, "left"), ranked


def weighted_values(long: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, feature_id, value, cu, cs): distinct values with their counts in each arm, zero being one of them."""
    by = [*keys, "feature_id"]
    counts = long.groupBy(*by, "value").agg(
        F.count_if(in_arm("unsafe")).alias("cu"),
        F.count_if(in_arm("safe")).alias("cs"),
    )
    zeros = long.groupBy(*by).agg(
        F.count_if(in_arm("unsafe")).alias("u"),
        F.count_if(in_arm("safe")).alias("s"),
    ).join(sizes, keys).select(
        *by,
        F.lit(0.0).cast(long.schema["value"].dataType).alias("value"),
        (F.col("n_unsafe") - F.col("u")).alias("cu"),
        (F.col("n_safe") - F.col("s")).alias("cs"),
    ).where("cu + cs > 0")
    return counts.unionByName(zeros)


def prune(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add reasons (the names of the rules that apply) and keep."""
    named = df.withColumn(
        "reasons",
        F.array_join(
            F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()))),
            ";",
        ),
    )
    return named.withColumn("keep", F.col("reasons") == "")


def prune_rules(
    least_frequency: float = 0.02,
    both_frequency: float = 0.95,
    least_score: float | Column = 0.15,
    most_magnitude: float = 1e4,
    either: bool = False,
) -> dict[str, Column]:
    """The rules for ranked features with freq_unsafe, freq_safe, score and mean_magnitude: rare among unsafe samples, so
    frequent in both arms (or in either) that they tell nothing apart, of low score, of a score that is no number, or of a
    magnitude that is none or extreme."""
    finite = lambda c: ~(F.isnan(c) | (F.abs(c) == float("inf")))
    return {
        "freq_unsafe": F.col("freq_unsafe") < least_frequency,
        "both_high": high_frequency(both_frequency, either),
        "score": F.col("score") < least_score,
        "nan_inf_score": ~finite(F.col("score")),
        "extreme_magnitude": ~finite(F.col("mean_magnitude")) | (F.col("mean_magnitude") > most_magnitude),
    }


def high_frequency(limit: float, either: bool) -> Column:
    """Both arms active above limit, or either."""
    a, b = F.col("freq_unsafe") > limit, F.col("freq_safe") > limit
    return a | b if either else a & b


def weight_sensitivity(scores: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """Ranks of every feature under each weight set (weight_id, w_hist, w_mu, w_ks)."""
    scored = scores.crossJoin(F.broadcast(weights)).withColumn(
        "weighted",
        F.col("w_hist") * F.col("hist_dist") + F.col("w_mu") * F.col("delta_mu") + F.col("w_ks") * F.col("ks_stat"),
    )
    return scored.withColumn(
        "rank",
        F.row_number().over(Window.partitionBy("weight_id", *keys).orderBy(F.desc("weighted"), F.asc("feature_id"))),
    )


def mutual_info(long: DataFrame, sizes: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """Mutual information (nats) of the arm and the value's bin: `bins` equal ones over the range of active entries, and
    one for zero. A binned estimate."""
    by = [*keys, "feature_id"]
    reach = long.groupBy(*by).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    place = F.when(
        F.col("hi") > F.col("lo"),
        F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)),
    ).otherwise(F.lit(0))
    active = long.join(reach, by).groupBy(*by, place.alias("bin")).agg(
        F.count_if(in_arm("unsafe")).alias("cu"),
        F.count_if(in_arm("safe")).alias("cs"),
    )
    zeros = long.groupBy(*by).agg(
        F.count_if(in_arm("unsafe")).alias("u"),
        F.count_if(in_arm("safe")).alias("s"),
    ).join(sizes, keys).select(
        *by,
        F.lit(-1).cast("long").alias("bin"),
        (F.col("n_unsafe") - F.col("u")).alias("cu"),
        (F.col("n_safe") - F.col("s")).alias("cs"),
    )
    counts = active.unionByName(zeros).join(sizes, keys)
    n = F.col("n_unsafe") + F.col("n_safe")
    part = lambda c, m: F.when(F.col(c) > 0, F.col(c) / n * F.log(F.col(c) * n / ((F.col("cu") + F.col("cs")) * F.col(m)))).otherwise(0.0)
    return counts.groupBy(*by).agg(F.sum(part("cu", "n_unsafe") + part("cs", "n_safe")).alias("mi"))


def assign_semantics(
    aucs: DataFrame,
    keys: list[str],
    tags: DataFrame,
    validated: str,
    least: float = 0.55,
) -> DataFrame:
    """For each feature (keys and its validated category) the category of the greatest AUC, whether they match, all AUCs
    as a map, the tags of the primary category if its AUC is high enough (else of the validated one) and the others."""
    wide = aucs.groupBy(*keys, validated).agg(
        F.max_by("category", F.struct("auc", F.expr("-length(category)"), "category")).alias("primary_category"), F.max("auc").alias("primary_auc"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "auc")))).alias("all_aucs"))
    assigned = F.when(F.col("primary_auc") >= least, F.col("primary_category")).otherwise(F.col(validated))
    out = wide.withColumns(
        {"category_match": F.col("primary_category") == F.col(validated), "assigned_category": assigned},
    )
    others = F.transform(
        F.filter(F.map_entries("all_aucs"), lambda e: (e.value >= least) & (e.key != F.col("primary_category"))),
        lambda e: e.key,
    )
    named = out.withColumns({"cross_categories": others, "is_cross": F.size(others) > 0})
    known = tags.select(F.col("category").alias("assigned_category"), F.col("tags").alias("assigned_tags"))
    return named.join(known, "assigned_category", "left")


def build_groups(sem: DataFrame, keys: list[str], most: int = 5, least: float = 0.55) -> DataFrame:
    """Groups of features per key: B (matching and of at least the least AUC, by AUC), C (repairs much, corrupts little), A (by repair), each of at
    most `most` features, with mean rates, purity and the union of tags."""
    kinds = [
        ("B", F.col("category_match") & (F.col("primary_auc") >= least), "primary_auc"),
        ("C", (F.col("repair_rate") >= 0.7) & (F.col("corrupt_rate") <= 0.1), "repair_rate"),
        ("A", F.lit(True), "repair_rate"),
    ]
    out = None
    for kind, gate, order in kinds:
        ranked = sem.where(gate).withColumn(
            "__r",
            F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order), F.asc("feature_id"))),
        ).where(F.col("__r") <= most)
        made = ranked.groupBy(*keys).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("__r", "feature_id"))), lambda x: x.feature_id).alias("feature_ids"), F.avg("repair_rate").alias("repair_rate"), F.avg("corrupt_rate").alias("corruption_rate"),
            F.avg(F.col("category_match").cast("int")).alias("semantic_purity"), F.avg("primary_auc").alias("avg_auc"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("assigned_tags")))).alias("tags")).withColumn("group_type", F.lit(kind))
        out = made if out is None else out.unionByName(made)
    return out.withColumn("group_id", F.concat_ws("-", *keys, "group_type"))


def group_aucs(
    long: DataFrame,
    sizes: DataFrame,
    keys: list[str],
    groups: DataFrame,
    replicates: int,
    share: float,
    seed: int,
) -> DataFrame:
    """(group_id, n_unsafe, replicate, aucs): the AUC of every feature of each group in resamples of the unsafe samples.

    A replicate draws max(2, n_unsafe * share) of the key's unsafe samples with replacement, the same for all its groups;
    safe samples stay as they are. Draw i of replicate r is the sample whose place is a hash of (seed, r, i) modulo their
    number, samples that are active anywhere first, by hash. A drawn sample wins against the safe values below its own and
    half of equal ones, so an AUC is a sum over draws, and silent samples add what value 0 wins.
    """
    members = groups.select("group_id", *keys, F.posexplode("feature_ids").alias("at", "feature_id"))
    by = [*keys, "feature_id"]
    own = long.join(members.select(*by).distinct(), by, "left_semi")
    values = weighted_values(own, sizes, keys)
    before = Window.partitionBy(*by).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    wins = values.withColumn("wins", 2 * F.coalesce(F.sum("cs").over(before), F.lit(0)) + F.col("cs"))
    # What a value of 0 wins: all safe values below it, and half of the zeros.
    zero = own.where(in_arm("safe")).groupBy(*by).agg(
        F.count("*").alias("seen"),
        F.count_if(F.col("value") < 0).alias("low"),
    )
    samples = long.where(in_arm("unsafe")).select(*keys, "sample_id").distinct()
    placed = group_rank(samples, keys, "sample_id", seed).select(*keys, "sample_id", (F.col("__r") - 1).alias("i"))
    drawn_n = F.greatest(F.lit(2), F.floor(F.col("n_unsafe") * F.lit(share)))
    draws = sizes.where("n_unsafe >= 2").select(
        *keys,
        "n_unsafe",
        F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"),
        drawn_n.alias("m"),
    )
    draws = draws.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("d"))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("replicate").cast("string"), F.col("d").cast("string")))
    picked = draws.select(
        *keys,
        "replicate",
        (F.conv(F.substring(key, 1, 15), 16, 10).cast("long") % F.col("n_unsafe")).alias("i"),
    )
    times = picked.groupBy(*keys, "replicate", "i").agg(F.count("*").alias("times")).join(placed, [*keys, "i"])
    base = 2 * F.coalesce("low", F.lit(0)) + F.col("n_safe") - F.coalesce("seen", F.lit(0))
    entries = own.where(in_arm("unsafe")).join(wins.select(*by, "value", "wins"), [*by, "value"])
    gained = entries.join(times, [*keys, "sample_id"]).groupBy(*by, "replicate").agg(
        F.sum(F.col("times") * F.col("wins")).alias("won"),
        F.sum("times").alias("active"),
    )
    frame = members.join(sizes, keys).join(zero, by, "left").select(
        "*",
        F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"),
    ).join(gained, [*by, "replicate"], "left")
    total = F.coalesce("won", F.lit(0)) + (drawn_n - F.coalesce("active", F.lit(0))) * base
    auc = F.coalesce(F.try_divide(total, 2 * F.col("n_safe") * drawn_n), F.lit(0.5))
    return frame.groupBy("group_id", "n_unsafe", "replicate").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", auc.alias("auc")))), lambda x: x.auc).alias("aucs"),
    )


def group_stability(
    long: DataFrame,
    sizes: DataFrame,
    keys: list[str],
    groups: DataFrame,
    replicates: int = 50,
    share: float = 0.8,
    seed: int = 42,
    jaccard: float = 0.5,
    rank_corr: float = 0.5,
    compared: int = 20,
    least_repair: float = 0.0,
    most_corruption: float = 0.2,
    least_auc: float = 0.6,
) -> DataFrame:
    """For each group (group_id, keys, feature_ids; few features): AUCs over resamples of its unsafe samples, and over all
    pairs of the first `compared` resamples the mean overlap of their top features (share of the group, one at least; of
    equal ones the last) and the mean rank correlation (0.5 where it is never defined). With fewer than two unsafe samples both are 0.5. groups also has repair_rate,
    corruption_rate, auc (over all samples) and exempt (whether the AUC doesn't count, null as false); a group is deployable
    if it repairs more than least_repair, corrupts at most most_corruption, tells samples apart and is stable in both
    respects; a rate that is missing is no reason to deploy it."""
    aucs = group_aucs(long, sizes, keys, groups, replicates, share, seed)
    n = F.size("aucs")
    by_auc = F.reverse(F.array_sort(F.transform("aucs", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    top = F.transform(
        F.slice(by_auc, F.lit(1), F.greatest(F.lit(1), F.floor(n * F.lit(share)).cast("int"))),
        lambda e: e.i,
    )
    centred = F.transform(
        "aucs",
        lambda x: F.size(F.filter("aucs", lambda y: y < x)) + (
            F.size(F.filter("aucs", lambda y: y == x)) + 1
        ) / 2 - (n + 1) / 2,
    )
    first = F.when(F.col("replicate") < compared, F.struct("replicate", top.alias("top"), centred.alias("ranks")))
    # At most `compared` entries for each group, each of a few features.
    held = aucs.groupBy("group_id", "n_unsafe").agg(
        F.array_sort(F.collect_list(first)).alias("r"),
        F.avg(F.aggregate("aucs", F.lit(0.0), lambda a, x: a + x) / n).alias("auc_mean"),
    )
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    pairs = F.flatten(F.transform("r", lambda a: F.transform(F.filter("r", lambda b: b.replicate > a.replicate), lambda b: F.struct(
        (F.size(F.array_intersect(a.top, b.top)) / F.size(F.array_union(a.top, b.top))).alias("j"), F.try_divide(dot(a.ranks, b.ranks), F.sqrt(dot(a.ranks, a.ranks) * dot(b.ranks, b.ranks))).alias("c")))))
    mean = lambda v: F.when((F.size(v) > 0) & (F.col("n_unsafe") >= 2), F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)).otherwise(0.5)
    paired = held.withColumn("p", pairs)
    out = paired.select(
        "group_id",
        "auc_mean",
        mean(F.transform("p", lambda x: x.j)).alias("jaccard"),
        mean(F.array_compact(F.transform("p", lambda x: x.c))).alias("rank_corr"),
    )
    judged = out.join(groups.select("group_id", "repair_rate", "corruption_rate", "auc", "exempt"), "group_id")
    auc_ok = (F.round("auc", 9) >= least_auc) | F.coalesce("exempt", F.lit(False))
    gates = [
        F.col("repair_rate") > least_repair,
        F.col("corruption_rate") <= most_corruption,
        auc_ok,
        F.round("jaccard", 9) >= jaccard,
        F.round("rank_corr", 9) >= rank_corr,
    ]
    ok = reduce(lambda a, b: a & b, gates)
    return judged.withColumns({"auc_ok": F.coalesce(auc_ok, F.lit(False)), "deployable": F.coalesce(ok, F.lit(False))}).drop("exempt")


def direction_vectors(samples: DataFrame, keys: list[str], layer: str, vector: str) -> DataFrame:
    """The unsafe mean less the safe mean in each dimension, scaled to the mean norm over its layer's keys."""
    long = samples.select(*keys, "arm", F.posexplode(vector).alias("dim", "value"))
    diff = long.groupBy(*keys, "dim").agg(
        (F.avg(F.when(in_arm("unsafe"), F.col("value"))) - F.avg(F.when(in_arm("safe"), F.col("value")))).alias("d"),
    )
    norm = diff.groupBy(*keys).agg(F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("norm"))
    mean = norm.withColumn("layer_norm", F.avg("norm").over(Window.partitionBy(layer)))
    return diff.join(mean, keys).select(
        *keys,
        "dim",
        (F.col("d") / F.nullif("norm", F.lit(0.0)) * F.col("layer_norm")).alias("direction"),
        "norm",
    )


def build_states(
    prompts: DataFrame,
    entries: DataFrame,
    ident: str,
    category: str,
    categories: list[str],
    heldout: list[str],
    groups: list[tuple[int, list[int]]],
    layer: int,
    size: int = 64,
    seed: int = 42,
) -> DataFrame:
    """(ident, known, state): for each prompt (ident, category) the projection of its entries in a layer, its category, and
    what groups of features do.

    entries has ident, layer, feature_id and value, a row for each that isn't zero. The projection has a sign for each
    feature and column, a bit of a hash of seed and feature, so features need no dense row and no table of signs; it is
    scaled to unit length, as its columns all are alike. The category is one-hot over categories, then a mark of held-out
    ones and one of all others (null too). A group (layer, features) gives the greatest and mean value of its features and
    the part above zero. What is absent is zero: a prompt without entries in the layer has a zero projection, and known
    says that it has some. One aggregate finds everything.
    """
    words = -(-size // 32)  # of 32 bits, four to a hash
    key = lambda w: F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("feature_id").cast("string"), F.lit(str(w // 4))))
    bits = {f"__w{w}": F.conv(F.substring(key(w), 8 * (w % 4) + 1, 8), 16, 10).cast("long") for w in range(words)}
    marked = entries.where("value != 0").withColumns(bits)
    v, here = F.col("value").cast("double"), F.col("layer") == layer
    sign = lambda j: 1 - 2 * F.getbit(F.col(f"__w{j // 32}"), F.lit(j % 32)).cast("double")
    sums = [F.sum(F.when(here, v * sign(j)).otherwise(0.0)).alias(f"__z{j}") for j in range(size)]
    for g, (own_layer, ids) in enumerate(groups):
        own = (F.col("layer") == own_layer) & F.col("feature_id").isin(ids)
        sums += [F.max(F.when(own, v)).alias(f"__m{g}"), F.sum(F.when(own, v)).alias(f"__s{g}"), F.count_if(own).alias(f"__n{g}"), F.count_if(own & (v > 0)).alias(f"__p{g}")]
    found = marked.groupBy(ident).agg(F.bool_or(here).alias("__known"), *sums)
    z = [F.coalesce(f"__z{j}", F.lit(0.0)) for j in range(size)]
    named = prompts.select(ident, F.col(category).cast("string").alias("__c")).join(found, ident, "left").withColumn("__z", F.array(*z))
    norm = F.sqrt(F.aggregate("__z", F.lit(0.0), lambda s, x: s + x * x))
    unit = F.transform("__z", lambda x: F.coalesce(F.try_divide(x, norm), F.lit(0.0)))
    c = F.coalesce("__c", F.lit(""))
    marks = [c == k for k in categories] + [c.isin(heldout), ~c.isin([*categories, *heldout])]
    parts = []
    for g, (_, ids) in enumerate(groups):
        most = F.when(F.col(f"__n{g}") < len(set(ids)), F.greatest(F.col(f"__m{g}"), F.lit(0.0))).otherwise(F.col(f"__m{g}"))
        parts += [F.coalesce(most, F.lit(0.0)), F.coalesce(f"__s{g}", F.lit(0.0)) / len(ids), F.coalesce(f"__p{g}", F.lit(0)) / len(ids)]
    state = F.concat(unit, F.array(*(m.cast("double") for m in marks)), *([F.array(*parts)] if parts else []))
    return named.select(ident, F.coalesce("__known", F.lit(False)).alias("known"), state.alias("state"))


def reconstruction_metrics(df: DataFrame, x: str, y: str) -> DataFrame:
    """Add relative_l2, mse, l0, active_fraction and cosine of a row's vector and its reconstruction."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    product = lambda a, b: total(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")))
    error = total(
        F.zip_with(x, y, lambda p, q: (p.cast("double") - q.cast("double")) * (p.cast("double") - q.cast("double"))),
    )
    l0 = F.size(F.filter(y, lambda v: v != 0))
    return df.withColumns({
        "relative_l2": F.try_divide(F.sqrt(error), F.sqrt(product(F.col(x), F.col(x)))), "mse": F.try_divide(error, F.size(x)), "l0": l0, "active_fraction": F.try_divide(l0, F.size(y)),
        "cosine": F.try_divide(product(F.col(x), F.col(y)), F.sqrt(product(F.col(x), F.col(x))) * F.sqrt(product(F.col(y), F.col(y)))),
    })


def reconstruction_summary(df: DataFrame, keys: list[str], most: float) -> DataFrame:
    """Mean, median, spread and bounds of relative_l2, and whether the mean is at most `most`; the median is exact, without
    a group's rows in one task."""
    c = "relative_l2"
    sums = df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(c).alias("mean"),
        F.stddev_pop(c).alias("sd"),
        F.min(c).alias("min"),
        F.max(c).alias("max"),
    )
    middle = exact_percentiles(df, keys, c, {"median": 0.5}).withColumnsRenamed({k: f"__{k}" for k in keys})
    same = [sums[k].eqNullSafe(middle[f"__{k}"]) for k in keys]
    joined = sums.join(middle, same, "left").drop(*(f"__{k}" for k in keys))
    return joined.withColumn("viable", F.col("mean") <= most)


def fidelity_state(df: DataFrame, keys: list[str], x: str, y: str, f: str) -> DataFrame:
    """Sums from which fidelity follows, as a table that can be stored and merged: for each key a row of scalars (dim -1)
    and one with the sum and squares of each dimension of the input.

    A row of df is a token: input x, its reconstruction y and the features f; tokens with a null among them don't count.
    """
    rows = df.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in (x, y, f)))).select(
        *keys,
        F.transform(x, lambda v: v.cast("double")).alias("x"),
        F.transform(y, lambda v: v.cast("double")).alias("y"),
        F.size(F.filter(f, lambda v: v != 0)).alias("active"),
    )
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    mean = total(F.col("x")) / F.size("x")
    scalars = rows.groupBy(*keys).agg(
        F.count("*").alias("tokens"),
        F.sum(F.size("x")).alias("elements"),
        F.sum(total(F.zip_with("x", "y", lambda p, q: (p - q) * (p - q)))).alias("sse"),
        F.sum(total(F.transform("x", lambda v: (v - mean) * (v - mean)))).alias("token_centred"),
        F.sum("active").alias("active"),
    ).withColumns({"dim": F.lit(-1), "s1": F.lit(0.0), "s2": F.lit(0.0)})
    by_dim = rows.select(*keys, F.posexplode("x").alias("dim", "v")).groupBy(*keys, "dim").agg(
        F.sum("v").alias("s1"),
        F.sum(F.col("v") * F.col("v")).alias("s2"),
    )
    return scalars.unionByName(by_dim, allowMissingColumns=True).select(*keys, "dim", *FIDELITY)


#: What a fidelity state sums.
FIDELITY = ("tokens", "elements", "sse", "token_centred", "active", "s1", "s2")


def merge_fidelity(*states: DataFrame, keys: list[str]) -> DataFrame:
    """The state of all tokens that any of the states has seen."""
    every = reduce(lambda a, b: a.unionByName(b), states)
    return every.groupBy(*keys, "dim").agg(*(F.sum(c).alias(c) for c in FIDELITY))


def fidelity_metrics(state: DataFrame, keys: list[str]) -> DataFrame:
    """Errors and explained variances of a state, around each token's mean and around each dimension's."""
    n = F.max("tokens").over(Window.partitionBy(*keys))
    spread = F.when(F.col("dim") >= 0, F.col("s2") - F.col("s1") * F.col("s1") / n)
    whole = state.withColumn("__spread", spread).groupBy(*keys).agg(
        *(F.sum(c).alias(c) for c in FIDELITY if c not in ("s1", "s2")),
        F.sum(F.when(F.col("dim") >= 0, F.col("s2"))).alias("squares"),
        F.sum("__spread").alias("centred"),
    )
    return whole.select(
        *keys,
        F.col("tokens").alias("token_count"),
        F.col("elements").alias("element_count"),
        F.try_divide("sse", "elements").alias("mse"),
        F.sqrt(F.try_divide("sse", "squares")).alias("relative_l2"),
        F.try_divide("sse", "token_centred").alias("normalized_mse"),
        (1 - F.try_divide("sse", "token_centred")).alias("explained_variance"),
        F.try_divide("sse", "centred").alias("featurewise_normalized_mse"),
        (1 - F.try_divide("sse", "centred")).alias("featurewise_explained_variance"),
        F.try_divide("active", "tokens").alias("mean_l0"),
    )
