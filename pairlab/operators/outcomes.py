"""Paired outcomes: a baseline against methods, seeds and strengths on the same prompts.

A paired row has prompt_id, its conditions (method, seed, ...), category, language, b0_vulnerable, b0_skipped,
is_vulnerable, skipped, valid and, where it matters, empty. Rates are null where their denominator is 0; a status column
says why, so no type is mixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlab.functions.text import column, emptiness
from pairlab.operators.stats import mcnemar_exact, wilson


def pair_conditions(
    baseline: DataFrame,
    methods: DataFrame,
    keys: list[str],
    outputs: DataFrame | None = None,
) -> DataFrame:
    """Each method's scan with the baseline's of the same keys (b0_vulnerable, b0_skipped), and its output if given."""
    base = baseline.select(*keys, F.col("is_vulnerable").alias("b0_vulnerable"), F.col("skipped").alias("b0_skipped"))
    out = methods.join(base, keys)
    return out.join(outputs, [*keys, "method"], "left") if outputs is not None else out


def flags(df: DataFrame) -> DataFrame:
    """Add repaired, b0_safe, corrupted and still_vulnerable: a skipped scan is never safe and never repaired."""
    return df.withColumns({
        "b0_safe": F.expr("NOT b0_vulnerable AND NOT b0_skipped"),
        "repaired": F.expr("b0_vulnerable AND valid AND NOT skipped AND NOT is_vulnerable"),
        "corrupted": F.expr("NOT b0_vulnerable AND NOT b0_skipped AND NOT skipped AND is_vulnerable"),
        "removed": F.expr("b0_vulnerable AND NOT is_vulnerable"),
    })


#: Definitions of a corrupted baseline-safe record.
CORRUPTION = {
    "finding": "is_vulnerable",
    "scanned_finding": "is_vulnerable AND NOT skipped",
    "any_failure": "is_vulnerable OR skipped OR NOT valid",
    "invalid_or_finding": "is_vulnerable OR NOT valid",
}


def method_metrics(paired: DataFrame, keys: list[str], targets: list[str] | None = None) -> DataFrame:
    """First definition: vrr is 1 less the method's vulnerable records over the baseline's, wherever they are, so new
    findings lower it. Skipped baselines count as safe. corrected_vrr adds back as vulnerable the invalid outputs of
    vulnerable baselines, of the categories in targets (all if None)."""
    safe = "NOT b0_vulnerable"
    counts = F.lit(True) if targets is None else F.col("category").isin(targets)
    counted = paired.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if("b0_vulnerable").alias("n_vulnerable"), F.count_if(F.expr(safe)).alias("n_safe"),
        F.count_if("is_vulnerable").alias("n_method_vulnerable"), F.count_if("skipped").alias("n_skipped"),
        F.count_if(F.expr(f"{safe} AND is_vulnerable")).alias("n_corrupted"), F.count_if("valid").alias("n_valid"),
        F.count_if(counts & ~F.col("valid")).alias("n_empty"), F.count_if(counts & F.expr("b0_vulnerable AND NOT valid")).alias("n_empty_vulnerable"),
    )
    left = F.col("n_method_vulnerable")
    return counted.withColumns({
        "vrr": 1 - F.try_divide(left, "n_vulnerable"),
        "corruption_rate": F.try_divide("n_corrupted", "n_safe"),
        "safe_to_safe": F.try_divide(F.col("n_safe") - F.col("n_corrupted"), "n_safe"),
        "validity_rate": F.try_divide("n_valid", "n"),
        "corrected_vrr": 1 - F.try_divide(left + F.col("n_empty_vulnerable"), "n_vulnerable"),
    })


def paired_metrics(paired: DataFrame, keys: list[str]) -> DataFrame:
    """Second definition: skipped baselines are no safe ones, and a repair must be valid and scanned.

    raw_vrr is 1 less the method's vulnerable records over the baseline's, so it can be below corr_vrr and below 0;
    removed_rate is the share of vulnerable baselines whose finding went, whatever came instead.
    """
    counted = flags(paired).groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if("b0_vulnerable").alias("n_vulnerable"), F.count_if("b0_safe").alias("n_safe"), F.count_if("repaired").alias("n_repaired"),
        F.count_if("removed").alias("n_removed"), F.count_if("corrupted").alias("n_corrupted"), F.count_if("valid").alias("n_valid"),
        F.count_if("is_vulnerable").alias("n_raw_vulnerable"), F.count_if(~F.col("skipped")).alias("n_scanned"), F.count_if("skipped").alias("n_skipped"),
    )
    return counted.withColumns({
        "n_corrected_vulnerable": F.col("n_vulnerable") - F.col("n_repaired"),
        "corr_vrr": F.try_divide("n_repaired", "n_vulnerable"),
        "raw_vrr": 1 - F.try_divide("n_raw_vulnerable", "n_vulnerable"),
        "removed_rate": F.try_divide("n_removed", "n_vulnerable"),
        "corruption_rate": F.try_divide("n_corrupted", "n_safe"),
        "validity_rate": F.try_divide("n_valid", "n"),
    })


def output_counts(outputs: DataFrame, keys: list[str], text: str, status: str, fallback: str) -> DataFrame:
    """Counts of what a method put out: strictly empty and only blank texts, failed generations (other than SUCCESS and
    WHITESPACE_ONLY), failed hooks and fallbacks (a fallback that isn't recorded is none)."""
    how = F.coalesce(F.col(status), F.lit(""))
    kind = emptiness(text)
    return outputs.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(kind == "empty").alias("n_strict_empty"),
        F.count_if(kind == "whitespace_only").alias("n_whitespace_only"),
        F.count_if(~how.isin("SUCCESS", "WHITESPACE_ONLY")).alias("n_failed"),
        F.count_if(F.contains(how, F.lit("HOOK"))).alias("n_hook_failed"),
        F.count_if(F.coalesce(F.col(fallback), F.lit("NONE")) != "NONE").alias("n_fallback"),
    )


def estimability(n: Column | str, least: int = 5) -> Column:
    return F.when(column(n) == 0, "NOT_ESTIMABLE").when(column(n) < least, "LOW_SUPPORT").otherwise("ESTIMABLE")


def per_category(paired: DataFrame, keys: list[str], taxonomy: DataFrame) -> DataFrame:
    """Outcomes for each condition and every category of taxonomy (category), with its estimability."""
    counted = flags(paired).groupBy(*keys, "category").agg(
        F.count("*").alias("n"), F.count_if("b0_vulnerable").alias("n_vulnerable"), F.count_if("repaired").alias("n_repaired"), F.count_if("b0_safe").alias("n_safe"), F.count_if("corrupted").alias("n_corrupted"), F.count_if("valid").alias("n_valid"))
    frame = paired.select(*keys).distinct().crossJoin(F.broadcast(taxonomy.select("category")))
    full = frame.join(counted, [*keys, "category"], "left").fillna(0)
    return full.withColumns(
        {
            "vrr": F.try_divide("n_repaired", "n_vulnerable"),
            "corruption_rate": F.try_divide("n_corrupted", "n_safe"),
            "validity_rate": F.try_divide("n_valid", "n"),
            "status": estimability("n_vulnerable"),
        },
    )


def rate_pivot(df: DataFrame, row: str, col: str, values: list, rate: str) -> DataFrame:
    return df.groupBy(row).pivot(col, values).agg(F.first(rate))


def seed_summary(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mean, sample deviation (null below two seeds), least and greatest of each metric over seeds."""
    parts = [
        f.alias(f"{m}_{n}") for m in metrics for n, f in (
            ("mean", F.avg(m)),
            ("sd", F.when(F.count(m) > 1, F.stddev_samp(m))),
            ("min", F.min(m)),
            ("max", F.max(m)),
        )
    ]
    return df.groupBy(*keys).agg(F.count("*").alias("n_seeds"), *parts)


def scope_summary(paired: DataFrame) -> DataFrame:
    """Outcomes overall, by category and by category and language, for each seed and for all: repairs among vulnerable
    baselines, corruptions among safe ones, and regressions (corruptions of valid outputs), each with its rate and Wilson
    bounds; outputs of vulnerable baselines that are invalid; the exact McNemar p of repairs against regressions; changed
    cases; and whether there was anything to repair."""
    marked = flags(paired).withColumns(
        {
            "regressed": F.expr("corrupted AND valid"),
            "unsafe_invalid": F.expr("b0_vulnerable AND NOT valid"),
            "changed": F.expr("b0_vulnerable <> is_vulnerable"),
        },
    )
    counted = ["b0_vulnerable", "repaired", "unsafe_invalid", "b0_safe", "corrupted", "regressed", "changed"]
    sets = [
        ["seed"],
        ["seed", "category"],
        ["seed", "category", "language"],
        [],
        ["category"],
        ["category", "language"],
    ]
    cols = [F.col("seed"), F.col("category"), F.col("language")]
    names = {"b0_vulnerable": "n_vulnerable", "b0_safe": "n_safe"}
    grouped = marked.select("seed", "category", "language", *counted).groupingSets([[F.col(c) for c in s] for s in sets], *cols).agg(
        F.grouping_id().alias("g"),
        F.count("*").alias("n"),
        *(F.count_if(c).alias(names.get(c, f"n_{c}")) for c in counted),
    )
    scope = F.when(F.col("g").bitwiseAND(3) == 3, "overall").when(
        F.col("g").bitwiseAND(3) == 1,
        "category",
    ).otherwise("category_language")
    rates = []
    for name, k, n in (("repair", "n_repaired", "n_vulnerable"), ("corruption", "n_corrupted", "n_safe"), ("regression", "n_regressed", "n_safe")):
        low, high = wilson(k, n)
        rates += [F.try_divide(k, n).alias(f"{name}_rate"), low.alias(f"{name}_low"), high.alias(f"{name}_high")]
    return grouped.select(
        "seed",
        "category",
        "language",
        scope.alias("scope"),
        F.when(F.col("g") >= 4, "ALL").otherwise("seed").alias("pooling"),
        "n",
        *(names.get(c, f"n_{c}") for c in counted),
        *rates,
        F.try_divide("n_unsafe_invalid", "n_vulnerable").alias("unsafe_invalid_rate"),
        mcnemar_exact("n_repaired", "n_regressed").alias("mcnemar_p"),
        F.when(F.col("n_vulnerable") > 0, "EVALUATED").otherwise("NO_VULNERABLE_BASELINE").alias("status"),
    )


REPAIRED, CORRUPTED = "arm = 'unsafe' AND valid AND NOT target_present", "arm = 'safe' AND valid AND any_finding"


def cell_ids(scans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, prompt_id, outcome) of the repaired and the corrupted records of each cell, one row each."""
    outcome = F.when(F.expr(REPAIRED), "repaired").when(F.expr(CORRUPTED), "corrupted")
    return scans.select(*keys, "prompt_id", outcome.alias("outcome")).where("outcome IS NOT NULL")


def cell_metrics(
    scans: DataFrame,
    keys: list[str],
    denominators: DataFrame,
    on: list[str],
    least: float,
    most: float,
) -> DataFrame:
    """Rates of each cell over fixed denominators (n_unsafe, n_safe by `on`) and whether the cell may be used.
    scans has arm ('unsafe' or 'safe'), prompt_id, valid, target_present, any_finding."""
    counted = scans.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(F.expr(REPAIRED)).alias("n_repaired"), F.count_if(F.expr(CORRUPTED)).alias("n_corrupted"), F.count_if(~F.col("valid")).alias("n_invalid"))
    rated = counted.join(denominators, on, "left").withColumns(
        {
            "repair_rate": F.try_divide("n_repaired", "n_unsafe"),
            "corruption_rate": F.try_divide("n_corrupted", "n_safe"),
            "invalid_rate": F.try_divide("n_invalid", "n"),
        },
    )
    return rated.withColumn(
        "admissible",
        F.coalesce((F.col("repair_rate") >= least) & (F.col("corruption_rate") <= most), F.lit(False)),
    )


def failed_gates(gates: dict[str, Column]) -> Column:
    """The names of the gates that don't hold, in order."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in gates.items())))


def validate_candidates(
    df: DataFrame,
    technical: dict[str, Column],
    gates: dict[str, Column],
    steered: str,
    baseline: str,
) -> DataFrame:
    """Add new_categories, failed_gates and a status: technical_failure, validated, failed_single_gate or failed_multiple_gates."""
    named = df.withColumn("new_categories", F.array_sort(F.array_except(steered, baseline)))
    bad, failed = failed_gates(technical), failed_gates(gates)
    status = F.when(F.size(bad) > 0, "technical_failure").when(F.size("failed_gates") == 0, "validated").when(
        F.size("failed_gates") == 1,
        "failed_single_gate",
    ).otherwise("failed_multiple_gates")
    return named.withColumn("failed_gates", F.concat(bad, failed)).withColumn("status", status)


def candidate_rollup(df: DataFrame, keys: list[str], ident: str, rate: str, gates: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("tested"), F.count_if(F.col("status") == "validated").alias("validated"), F.min(rate).alias("min_rate"), F.max(rate).alias("max_rate"),
        *(F.count_if(F.array_contains("failed_gates", g)).alias(f"failed_{g}") for g in gates), F.array_sort(F.collect_list(F.when(F.col("status") == "validated", F.col(ident)))).alias("validated_ids"))


def qualify(df: DataFrame) -> DataFrame:
    """Add reason: null for candidates that count (unsafe ones whose target came again, safe ones without a finding)."""
    reason = F.when(~F.col("valid"), "invalid").when(F.col("skipped"), "skipped").when(
        (F.col("population") == "unsafe") & ~F.col("target_present"),
        "target_not_replicated",
    ).when((F.col("population") == "safe") & F.col("any_finding"), "finding_in_safe")
    return df.withColumn("reason", reason)


def qualified_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return qualify(df).groupBy(
        *keys,
        "population",
        F.coalesce("reason", F.lit("qualified")).alias("reason"),
    ).agg(F.count("*").alias("n"))


def sweep_steps(
    df: DataFrame,
    keys: list[str],
    order: str,
    reference: object,
    rates: list[str],
    corruption: float = 0.05,
    validity: float = 0.95,
) -> DataFrame:
    """Each step of a sweep: its corruption and validity, whether either crosses its limit, and for the other rates (of
    empty and blank outputs, say) how far they are from those of the reference step, up or down."""
    base = df.where(F.col(order) == F.lit(reference)).select(
        *(F.col(k).alias(f"__{k}") for k in keys),
        *(F.col(r).alias(f"__{r}") for r in rates),
    )
    joined = df.join(base, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left") if keys else df.join(base, how="left")
    return joined.select(
        *keys,
        order,
        "corruption_rate",
        "validity_rate",
        F.coalesce(F.col("corruption_rate") > corruption, F.lit(False)).alias("corruption_crossed"),
        F.coalesce(F.col("validity_rate") < validity, F.lit(False)).alias("validity_crossed"),
        *rates,
        *(F.abs(F.col(r) - F.col(f"__{r}")).alias(f"{r}_difference") for r in rates),
    )


def first_boundary(
    df: DataFrame,
    keys: list[str],
    order: str,
    corruption: float = 0.05,
    validity: float = 0.95,
    reference: object = None,
) -> DataFrame:
    """The first step of a sweep at which corruption or validity crosses its limit, why, and the change of validity and
    corruption from the reference step (the first one, if none is named)."""
    why = F.array_compact(
        F.array(
            F.when(F.col("corruption_rate") > corruption, F.lit("corruption")),
            F.when(F.col("validity_rate") < validity, F.lit("validity")),
        ),
    )
    marked = df.withColumn("__why", why)
    crossed = F.when(F.size("__why") > 0, F.col(order))
    ref = F.lit(reference) if reference is not None else F.min(order)
    found = marked.groupBy(*keys).agg(
        F.min(crossed).alias("boundary"),
        ref.alias("reference") if reference is None else F.first(ref).alias("reference"),
    )
    at = df.select(
        *keys,
        F.col(order).alias("boundary"),
        F.col("corruption_rate").alias("bc"),
        F.col("validity_rate").alias("bv"),
    )
    base = df.select(
        *keys,
        F.col(order).alias("reference"),
        F.col("corruption_rate").alias("rc"),
        F.col("validity_rate").alias("rv"),
    )
    joined = found.join(at, [*keys, "boundary"], "left").join(base, [*keys, "reference"], "left")
    reasons = F.concat_ws(
        ",",
        F.when(F.col("bc") > corruption, "corruption"),
        F.when(F.col("bv") < validity, "validity"),
    )
    return joined.select(
        *keys,
        "boundary",
        reasons.alias("reasons"),
        (F.col("bc") - F.col("rc")).alias("corruption_change"),
        (F.col("bv") - F.col("rv")).alias("validity_change"),
    )


def seed_consistency(paired: DataFrame, ident: str, seeds: list[int]) -> DataFrame:
    """For each prompt whether it was repaired with each seed (null where not eligible), how often, and over how many."""
    eligible = flags(paired).where("b0_vulnerable")
    wide = eligible.groupBy(ident).pivot("seed", seeds).agg(F.bool_or("repaired"))
    cols = [F.col(str(s)) for s in seeds]
    times, of = sum((F.coalesce(c.cast("int"), F.lit(0)) for c in cols), F.lit(0)), sum(
        (c.isNotNull().cast("int") for c in cols),
        F.lit(0),
    )
    status = F.when(of == 0, "NOT_ELIGIBLE").when(times == of, "ALWAYS").when(times == 0, "NEVER").otherwise("MIXED")
    return wide.select(
        ident,
        *(c.alias(f"seed_{s}") for s, c in zip(seeds, cols, strict=True)),
        times.alias("n_repaired"),
        of.alias("n_eligible"),
        status.alias("status"),
    )


def changed_cases(paired: DataFrame) -> DataFrame:
    """Pairs whose status differs, with the direction."""
    direction = F.when(F.expr("b0_vulnerable AND NOT is_vulnerable"), "removed").otherwise("introduced")
    return paired.where("b0_vulnerable != is_vulnerable").withColumn("direction", direction)


def status_map(df: DataFrame, keys: list[str], status: str) -> DataFrame:
    """A map from status to its number of rows, for each key."""
    counts = df.groupBy(*keys, status).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(status, "n")))).alias("statuses"),
    )


def routing_coverage(df: DataFrame, keys: list[str]) -> DataFrame:
    counted = df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if("supported").alias("n_supported"),
        F.count_if(~F.col("supported")).alias("n_unsupported"),
        F.count_if(F.expr("supported AND NOT fallback")).alias("n_active"),
        F.count_if("fallback").alias("n_fallback"),
    )
    return counted.withColumn("active_rate", F.try_divide("n_active", "n"))


def gate_rate(df: DataFrame, keys: list[str], log: str, gated: str) -> DataFrame:
    """Steps and gated steps of nested logs (array<struct>), and their share."""
    counted = df.groupBy(*keys).agg(
        F.sum(F.size(log)).alias("n_steps"),
        F.sum(F.size(F.filter(log, lambda s: s[gated]))).alias("n_gated"),
    )
    return counted.withColumn("gate_rate", F.try_divide("n_gated", "n_steps"))


def evidence_table(
    taxonomy: DataFrame,
    counts: dict[str, DataFrame],
    ladder: list[tuple[str, Column]],
    claimed: str | None = None,
) -> DataFrame:
    """Join a count table (category, n) for each name to every category, and give the first step of the ladder that holds;
    with a column of taxonomy that claims support, say where it differs from having any."""
    out = taxonomy
    for name, table in counts.items():
        out = out.join(table.select("category", F.col("n").alias(name)), "category", "left").fillna(0, [name])
    step = F.coalesce(*(F.when(c, F.lit(n)) for n, c in ladder), F.lit("NONE"))
    out = out.withColumn("evidence", step)
    return out.withColumn("mismatch", F.col(claimed) != (F.col("evidence") != "NONE")) if claimed else out


def recurrence(df: DataFrame, feature: list[str], category: str, categories: list[str], k: int = 2) -> DataFrame:
    """Features that occur in at least k categories, with a presence matrix."""
    present = [F.bool_or(F.col(category) == c).alias(f"in_{c}") for c in categories]
    return df.groupBy(*feature).agg(
        F.count_distinct(category).alias("n_categories"),
        *present,
    ).where(F.col("n_categories") >= k)


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value, n) of several columns in one pass."""
    pairs = F.explode(
        F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols)),
    )
    return df.select(pairs.alias("p")).groupBy("p.column", "p.value").agg(F.count("*").alias("n"))


def dataset_stats(df: DataFrame, keys: list[str], augmented: Column) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.count_if(~augmented).alias("raw"),
        F.count_if(augmented).alias("augmented"),
        F.avg(augmented.cast("int")).alias("augmented_fraction"),
    )


def stage_counts(tables: dict[str, DataFrame], category: str) -> DataFrame:
    """Rows of each category at each stage; 0 where a stage has none."""
    tagged = None
    for stage, df in tables.items():
        part = df.groupBy(
            F.col(category).alias("category"),
        ).agg(F.count("*").alias("n")).withColumn("stage", F.lit(stage))
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.groupBy("category").pivot("stage", list(tables)).agg(F.sum("n")).fillna(0)


def top_ranked(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    ranked = df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("__r") <= k).drop("__r")
