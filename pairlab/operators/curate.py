"""Curation of pairs from fix commits: joins, first occurrences, unions, lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def link_commits(commits: DataFrame, fixes: DataFrame, classes: DataFrame, files: DataFrame) -> DataFrame:
    """One row for each (hash, vulnerability, category, language) of commits (hash, ...), fixes (hash, vuln_id), classes
    (vuln_id, category) and files (hash, language). Each side is made distinct before it joins, so fan-out is only what
    the result has, and rows without a vulnerability go round the second join instead of meeting in one task."""
    linked = commits.join(fixes.select("hash", "vuln_id").distinct(), "hash", "left")
    known = linked.where("vuln_id IS NOT NULL").join(
        classes.select("vuln_id", "category").distinct(),
        "vuln_id",
        "left",
    )
    rest = linked.where("vuln_id IS NULL").withColumn(
        "category",
        F.lit(None).cast(classes.schema["category"].dataType),
    )
    both = known.unionByName(rest)
    return both.join(files.select("hash", "language").distinct(), "hash", "left").distinct()


def classify_with_registry(df: DataFrame, ident: str, verified: DataFrame, decision: Column) -> DataFrame:
    """Verified ids (id) count as security patches whatever the heuristic says; decided_by says which of the two decided.
    A row without an id is left to the heuristic."""
    known = verified.select(F.lower(F.trim("id")).alias("__id")).distinct()
    out = df.join(known, F.lower(F.trim(F.col(ident))) == F.col("__id"), "left")
    hit = F.col("__id").isNotNull()
    return out.withColumns(
        {
            "decision": F.when(hit, "security_patch").otherwise(decision),
            "decided_by": F.when(hit, "registry").otherwise("heuristic"),
        },
    ).drop("__id")


def build_candidate_pairs(files: DataFrame, accepted: DataFrame, key: str) -> DataFrame:
    """Files of accepted commits, with what is known of each commit; texts are read for those files only."""
    ids = accepted.select(key).distinct()
    return files.join(ids, key, "left_semi").join(accepted.distinct(), key)


def method_rows(
    methods: DataFrame,
    files: DataFrame,
    fixes: DataFrame,
    seeds: DataFrame,
    languages: list[str],
) -> DataFrame:
    """Methods (file_id, ...) of files (file_id, hash, language) in given languages whose commit fixes (hash, vuln_id) a seed (vuln_id)."""
    wanted = fixes.join(seeds.select("vuln_id").distinct(), "vuln_id", "left_semi")
    return methods.join(files.where(F.col("language").isin(languages)), "file_id").join(wanted, "hash")


def first_by_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    ranked = df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__r = 1").drop("__r")


def top_k(df: DataFrame, keys: list[str], score: str, ident: str, k: int) -> DataFrame:
    """The k rows of highest score in each group, ties by id; adds rank."""
    ranked = df.withColumn(
        "rank",
        F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(ident))),
    )
    return ranked.where(F.col("rank") <= k)


def head_per_group(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The first n rows of each group in source order, which is a column."""
    ranked = df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    return ranked.where(F.col("__r") <= n).drop("__r")


def rank_shift(
    df: DataFrame,
    setting: str,
    reference: object,
    keys: list[str],
    ident: str,
    score: str,
    k: int,
) -> tuple[DataFrame, DataFrame]:
    """Each feature's rank and its change from the reference setting; and the overlap of the top k with the reference's."""
    ranked = df.withColumn(
        "rank",
        F.row_number().over(Window.partitionBy(setting, *keys).orderBy(F.desc(score), F.asc(ident))),
    )
    base = ranked.where(F.col(setting) == reference).select(*keys, ident, F.col("rank").alias("reference_rank"))
    moved = ranked.join(base, [*keys, ident], "left").withColumn("shift", F.col("rank") - F.col("reference_rank"))
    top = moved.groupBy(setting, *keys).agg(
        F.count_if(F.col("rank") <= k).alias("n"),
        F.count_if((F.col("rank") <= k) & (F.col("reference_rank") <= k)).alias("both"),
    )
    size = base.groupBy(*keys).agg(F.count_if(F.col("reference_rank") <= k).alias("m"))
    overlap = top.join(size, keys).select(
        setting,
        *keys,
        "both",
        (F.col("both") / (F.col("n") + F.col("m") - F.col("both"))).alias("jaccard"),
    )
    return moved, overlap


def union_pairs(raw: DataFrame, augmented: DataFrame) -> DataFrame:
    return raw.unionByName(augmented, allowMissingColumns=True)


def compare_selections(a: DataFrame, b: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Common, added and removed keys of b against a for each value of by, and the Jaccard similarity."""
    x, y = a.select(*by, *keys).distinct().withColumn(
        "__a",
        F.lit(True),
    ), b.select(*by, *keys).distinct().withColumn("__b", F.lit(True))
    both = x.join(y, [*by, *keys], "full_outer").select(
        *by,
        F.coalesce("__a", F.lit(False)).alias("__a"),
        F.coalesce("__b", F.lit(False)).alias("__b"),
    )
    counted = both.groupBy(*by).agg(
        F.count_if(F.expr("__a AND __b")).alias("common"),
        F.count_if(F.expr("NOT __a")).alias("added"),
        F.count_if(F.expr("NOT __b")).alias("removed"),
    )
    return counted.withColumn("jaccard", F.col("common") / (F.col("common") + F.col("added") + F.col("removed")))


def lineage_check(df: DataFrame, sources: DataFrame, key: str, fields: list[str], seed: str) -> DataFrame:
    """(key, problem): rows without a source row, with a field that differs from it, or whose seed is no source."""
    known = sources.select(key, *(F.col(f).alias(f"__{f}") for f in fields), F.lit(True).alias("__known"))
    seeds = sources.select(F.col(key).alias(seed), F.lit(True).alias("__seed")).distinct()
    joined = df.join(known, key, "left").join(seeds, seed, "left")
    missing = F.col("__known").isNull()
    problems = [
        F.when(missing, "missing_source"),
        *(F.when(~missing & ~F.col(f).eqNullSafe(F.col(f"__{f}")), f"differs_{f}") for f in fields),
        F.when(F.col(seed).isNotNull() & F.col("__seed").isNull(), "missing_seed"),
    ]
    return joined.select(key, F.explode(F.array_compact(F.array(*problems))).alias("problem"))


def coverage_gaps(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are expected but missing, or there but not expected."""
    e, a = expected.select(*keys).distinct(), actual.select(*keys).distinct()
    return e.join(a, keys, "left_anti").withColumn("gap", F.lit("missing")).unionByName(
        a.join(e, keys, "left_anti").withColumn("gap", F.lit("unexpected")),
    )


def cross_split_leakage(df: DataFrame, split: str, key: Column) -> DataFrame:
    """(key, splits, rows) of keys that occur in more than one split."""
    return df.select(key.alias("key"), split).groupBy("key").agg(
        F.count_distinct(split).alias("splits"),
        F.count("*").alias("rows"),
    ).where("splits > 1")


def build_worklist(
    population: DataFrame,
    routes: DataFrame,
    seeds: list[int],
    category: str,
    ident: str,
) -> DataFrame:
    """Each record of the population with its category's route and every seed, under a record id."""
    every = F.explode(F.array(*(F.lit(x) for x in seeds)))
    routed = population.join(routes, category).withColumn("seed", every)
    return routed.withColumn(
        "record_id",
        F.concat_ws(":", F.col(category), F.col("seed").cast("string"), F.col(ident).cast("string")),
    )


def assign_arms(vectors: DataFrame, labels: DataFrame, ident: str) -> DataFrame:
    """Vectors with the arm (unsafe or safe) they have for each category of labels (id, category, unsafe)."""
    return vectors.join(
        labels.select(ident, "category", F.when(F.col("unsafe"), "unsafe").otherwise("safe").alias("arm")),
        ident,
    )


def attach_metadata(df: DataFrame, metadata: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their metadata, and the keys that have none (callers fail if there are any)."""
    joined = df.join(metadata.withColumn("__known", F.lit(True)), key, "left")
    return joined.drop("__known"), joined.where("__known IS NULL").select(key)


