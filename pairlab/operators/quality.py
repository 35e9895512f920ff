"""Checks of records: each gives one row per violation or per check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def violations(df: DataFrame, ident: list[str], rules: dict[str, Column]) -> DataFrame:
    """(ident, rule) for each rule that a row breaks; a rule that is null counts as broken."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())))
    return df.select(*ident, F.explode(broken).alias("rule"))


def check_chain(
    prompts: DataFrame,
    outputs: DataFrame,
    scans: DataFrame,
    key: str,
    shared: list[str],
    rules: dict[str, Column],
) -> DataFrame:
    """Rows of three chained tables, joined by key, that break a rule or differ in a shared column."""
    renamed = lambda df, p: df.select(key, *(F.col(c).alias(f"{p}_{c}") for c in df.columns if c != key))
    joined = renamed(prompts, "prompt").join(renamed(outputs, "output"), key, "full_outer").join(
        renamed(scans, "scan"),
        key,
        "full_outer",
    )
    equal = {
        f"{p}_{c}": F.col(f"prompt_{c}").eqNullSafe(F.col(f"{p}_{c}")) for c in shared for p in ("output", "scan")
    }
    return violations(joined, [key], equal | rules)


def split_report(
    df: DataFrame,
    split: str,
    unit: str,
    category: str,
    heldout: list[str],
    minimums: dict[str, int],
    ratio: float = 3.0,
    augmented: Column | None = None,
    most_augmented: float = 0.5,
    secure: Column | None = None,
    total: int = 500,
) -> DataFrame:
    """(check, category, status, observed, limit) on a split table; category is null for checks of the whole.

    Units in several splits (held-out rows in test don't count); held-out rows in each other split; rows of each derivation
    category, of which minimums has the least number (one without rows fails); the largest of those categories that have
    rows against the smallest; the augmented part of every category; the part of every category that is secure, which
    only warns; all rows.
    """
    held = F.col(category).isin(heldout)
    known = lambda c: F.coalesce(c, F.lit(False)).cast("double") if c is not None else F.lit(None).cast("double")
    units = df.where(~(held & (F.col(split) == "test"))).groupBy(unit).agg(F.count_distinct(split).alias("n")).agg(
        F.count_if(F.col("n") > 1).alias("overlap"),
    )
    # A row for each category of the table or of minimums.
    counted = df.groupBy(F.col(category).alias("c")).agg(
        F.count("*").alias("n"),
        F.count_if(held & (F.col(split) != "test")).alias("outside"),
        F.avg(known(augmented)).alias("augmented"),
        F.avg(known(secure)).alias("secure"),
    )
    least = df.sparkSession.createDataFrame(list(minimums.items()), "c string, least long")
    counts = counted.join(least, "c", "full_outer").withColumn("n", F.coalesce("n", F.lit(0)))
    derived = F.when(F.col("least").isNotNull() & (F.col("n") > 0), F.col("n"))
    whole = counts.agg(
        F.sum("outside").alias("outside"),
        F.try_divide(F.max(derived), F.min(derived)).alias("spread"),
        F.sum("n").alias("total"),
    )

    def check(name: str, ok: Column, observed: Column, limit: Column, failed: str = "FAIL") -> Column:
        status = F.when(F.coalesce(ok, F.lit(True)), "PASS").otherwise(failed)
        return F.struct(F.lit(name).alias("check"), status.alias("status"), observed.cast("double").alias("observed"), limit.cast("double").alias("limit"))

    n = F.col
    for_all = [
        check("unit_overlap", n("overlap") <= 0, n("overlap"), F.lit(0)),
        check("heldout_outside_test", n("outside") <= 0, F.coalesce("outside", F.lit(0)), F.lit(0)),
        check("category_ratio", n("spread") <= ratio, n("spread"), F.lit(ratio)),
        check("total", F.coalesce("total", F.lit(0)) >= total, F.coalesce("total", F.lit(0)), F.lit(total)),
    ]
    for_each = [
        F.when(n("least").isNotNull(), check("category_minimum", n("n") >= n("least"), n("n"), n("least"))),
        F.when(n("augmented").isNotNull(), check("augmented_fraction", n("augmented") <= most_augmented, n("augmented"), F.lit(most_augmented))),
        F.when(n("secure").isNotNull(), check("secure_fraction", n("secure") >= 1, n("secure"), F.lit(1), "WARN")),
    ]
    first = units.crossJoin(whole).select(F.lit(None).cast("string").alias("category"), F.explode(F.array(*for_all)).alias("k"))  # one row each
    each = counts.select(F.col("c").alias("category"), F.explode(F.array_compact(F.array(*for_each))).alias("k"))
    return first.unionByName(each).select("k.check", "category", "k.status", "k.observed", "k.limit")


def set_checks(
    sets: dict[str, DataFrame],
    key: str,
    disjoint: list[tuple[str, str]],
    nested: list[tuple[str, str]],
) -> DataFrame:
    """(check, a, b, violations): common keys of sets that must be disjoint, and keys of a that b lacks where a must lie in b."""
    out = None
    for kind, pairs, how in (("disjoint", disjoint, "left_semi"), ("nested", nested, "left_anti")):
        for a, b in pairs:
            n = sets[a].select(key).distinct().join(sets[b].select(key).distinct(), key, how).agg(
                F.count("*").alias("violations"),
            )
            row = n.select(F.lit(kind).alias("check"), F.lit(a).alias("a"), F.lit(b).alias("b"), "violations")
            out = row if out is None else out.unionByName(row)
    return out


def drift(df: DataFrame, manifest: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, state) of records that are new, missing or changed against recorded digests (key, sha256)."""
    now = df.select(key, F.sha2(text, 256).alias("now"))
    both = now.join(manifest.select(key, "sha256"), key, "full_outer")
    state = F.when(F.col("sha256").isNull(), "new").when(F.col("now").isNull(), "missing").when(
        F.col("now") != F.col("sha256"),
        "changed",
    )
    return both.select(key, state.alias("state")).where("state IS NOT NULL")


def metric_drift(
    reported: DataFrame,
    recomputed: DataFrame,
    keys: list[str],
    metric: str,
    tolerance: float,
) -> DataFrame:
    """Keys whose metric differs by more than tolerance, or is there once only."""
    both = reported.select(*keys, F.col(metric).alias("reported")).join(
        recomputed.select(*keys, F.col(metric).alias("recomputed")),
        keys,
        "full_outer",
    )
    return both.where(
        F.coalesce(
            F.abs(F.col("reported") - F.col("recomputed")) > tolerance,
            F.col("reported").isNull() | F.col("recomputed").isNull(),
        ),
    )


def forbidden_fields(df: DataFrame, ident: list[str], fields: list[str]) -> DataFrame:
    """(ident, field) of fields that must be absent or empty and aren't; fields that df lacks are fine."""
    there = [f for f in fields if f in df.columns]
    bad = F.array_compact(
        F.array(
            *(F.when(F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")) != "", F.lit(f)) for f in there),
        ).cast("array<string>"),
    )
    return df.select(*ident, F.explode(bad).alias("field"))
