"""Summaries of latency, throughput and staged cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.operators.quantiles import exact_percentiles


def latency_summary(df: DataFrame, latency: str, failed: str, fallback: str) -> DataFrame:
    """Sum, mean, median, least, greatest, failures and fallbacks for each (method, repetition) and each method (ALL).

    Medians are exact and found by narrowing ranges, so no method's latencies meet in one task."""
    named = df.withColumn("repetition", F.col("repetition").cast("string"))
    grouped = named.groupingSets(
        [[F.col("method"), F.col("repetition")], [F.col("method")]],
        F.col("method"),
        F.col("repetition"),
    ).agg(
        F.grouping("repetition").alias("__g"),
        F.count("*").alias("n"),
        F.sum(latency).alias("total"),
        F.avg(latency).alias("mean"),
        F.min(latency).alias("min"),
        F.max(latency).alias("max"),
        F.count_if(failed).alias("failures"),
        F.count_if(fallback).alias("fallbacks"),
    )
    both = F.explode(F.array(F.struct(F.lit(0).alias("g"), F.col("repetition").alias("r")), F.struct(F.lit(1).alias("g"), F.lit(None).cast("string").alias("r"))))
    twice = named.select("method", F.col(latency).alias("__x"), both.alias("s")).select("method", "s.g", "s.r", "__x")
    medians = exact_percentiles(twice, ["method", "g", "r"], "__x", {"median": 0.5}).withColumnRenamed("method", "__m")
    same = (F.col("method").eqNullSafe(F.col("__m"))) & (F.col("__g") == F.col("g")) & F.col("repetition").eqNullSafe(F.col("r"))
    return grouped.join(medians, same, "left").withColumn(
        "repetition",
        F.when(F.col("__g") == 1, "ALL").otherwise(F.col("repetition")),
    ).drop("__g", "__m", "g", "r")


def throughput(df: DataFrame, keys: list[str], latency: str, tokens: str, calls: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sum(latency).alias("seconds"),
        F.sum(tokens).alias("tokens"),
        F.sum(calls).alias("calls"),
    ).withColumns({"tokens_per_second": F.try_divide("tokens", "seconds"), "calls_per_record": F.try_divide("calls", "n"), "seconds_per_record": F.try_divide("seconds", "n")})


def overhead(df: DataFrame, key: str, value: str, base: str) -> DataFrame:
    """Ratio and percentage of each method's value against the base method's."""
    one = df.where(F.col(key) == base).select(F.col(value).alias("__base"))
    return df.crossJoin(F.broadcast(one)).withColumns(
        {"ratio": F.try_divide(value, "__base"), "percent": (F.try_divide(value, "__base") - 1) * 100},
    ).drop("__base")


def stage_cost(
    df: DataFrame,
    record: list[str],
    stages: list[str],
    order: str,
    complete: str = "COMPLETED",
) -> tuple[DataFrame, DataFrame]:
    """Rows, calls, tokens, seconds and a map of row counts by status, for each stage and all of them (ALL); and the number
    of records that don't have all stages complete and in order. df has record, stage, the order column, call (null where
    none was made), tokens, seconds, status."""
    sets = [[F.col("stage"), F.col("status")], [F.col("status")]]
    parts = df.groupingSets(sets, F.col("stage"), F.col("status")).agg(
        F.grouping("stage").alias("__g"),
        F.count("*").alias("n"),
        F.count("call").alias("calls"),
        F.sum("tokens").alias("tokens"),
        F.sum("seconds").alias("seconds"),
    )
    status = F.coalesce("status", F.lit("NOT_RECORDED"))
    by = parts.groupBy("__g", "stage").agg(
        F.sum("n").alias("n_rows"),
        F.sum("calls").alias("calls"),
        F.sum("tokens").alias("tokens"),
        F.sum("seconds").alias("seconds"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(status.alias("status"), "n")))).alias("statuses"),
        F.sum(F.when(status != complete, F.col("n")).otherwise(0)).alias("n_incomplete"),
    ).withColumn("stage", F.when(F.col("__g") == 1, "ALL").otherwise(F.col("stage"))).drop("__g")
    seen = df.where(F.col("status") == complete).groupBy(*record).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(order, "stage"))), lambda x: x.stage).alias("seen"),
    )
    every = df.select(*record).distinct().join(seen, record, "left")
    bad = every.agg(
        F.count("*").alias("n_records"),
        F.count_if(
            ~F.coalesce(F.col("seen") == F.array(*(F.lit(s) for s in stages)), F.lit(False)),
        ).alias("n_structural_failures"),
    )
    return by, bad
