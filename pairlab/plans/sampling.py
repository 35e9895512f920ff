"""Queries of samples and splits over orders: the unit is the customer, the category the priority, status P augmented."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlab.operators import sampling as sm
from pairlab.registry import query, table

H = "md5('42|' || o_orderkey)"
O = f"o AS (SELECT *, o_orderstatus = 'P' AS is_augmented, {H} AS h FROM orders)"


def orders(spark, sf):
    return table(spark, sf, "orders").withColumn("is_augmented", F.col("o_orderstatus") == "P")


@query(
    "m1_cap_augmented",
    f"WITH {O}, g AS (SELECT o_orderpriority, count(*) FILTER (NOT is_augmented) AS raw FROM o GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, is_augmented ORDER BY h, o_orderkey) AS r FROM o JOIN g USING (o_orderpriority)) SELECT o_orderkey FROM r WHERE NOT is_augmented OR raw = 0 OR r <= floor(raw * 0.01 / (1 - 0.01))",
)
def m1(spark, sf):
    return sm.cap_augmented(
        orders(spark, sf),
        ["o_orderpriority"],
        "is_augmented",
        "o_orderkey",
        0.01,
        42,
    ).select("o_orderkey")


TREATED = "o_orderpriority <> '5-LOW'"


def balanced_sql(keys: str, ratio: float) -> str:
    return f"""WITH {O}, n AS (SELECT {keys}, count(*) AS n FROM o WHERE {TREATED} GROUP BY ALL), g AS (SELECT floor(min(n) * CASE WHEN max(n) > 3 * min(n) THEN 3 ELSE {ratio} END) AS cap FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY is_augmented, h, o_orderkey) AS r FROM o, g) SELECT o_orderkey FROM r WHERE r <= cap OR NOT ({TREATED})"""


@query("m2_balance_groups", balanced_sql("o_orderpriority, o_custkey % 7", 1.2))
def m2(spark, sf):
    return sm.balance_groups(
        orders(spark, sf).withColumn("g", F.col("o_custkey") % 7),
        ["o_orderpriority", "g"],
        "is_augmented",
        "o_orderkey",
        1.2,
        42,
        treated=F.expr(TREATED),
    ).select("o_orderkey")


@query("m2_balance_groups_relaxed", balanced_sql("o_orderpriority, o_orderstatus", 2.0))
def m2_relaxed(spark, sf):
    return sm.balance_groups(
        orders(spark, sf),
        ["o_orderpriority", "o_orderstatus"],
        "is_augmented",
        "o_orderkey",
        2.0,
        42,
        treated=F.expr(TREATED),
    ).select("o_orderkey")


@query(
    "m3_split_by_unit",
    f"WITH {O}, u AS (SELECT o_custkey, row_number() OVER (ORDER BY md5('42|' || o_custkey)) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey FROM o WHERE o_orderpriority <> '5-LOW')) SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'test' WHEN r <= floor(n * 0.6) THEN 'train' WHEN r <= floor(n * 0.6) + floor(n * 0.2) THEN 'validation' ELSE 'test' END AS split FROM o LEFT JOIN u USING (o_custkey)",
)
def m3(spark, sf):
    return sm.split_by_unit(
        orders(spark, sf),
        "o_custkey",
        (0.6, 0.2),
        F.col("o_orderpriority") == "5-LOW",
        42,
    ).select("o_orderkey", "split")


@query(
    "m4_split_rows",
    f"WITH {O} SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY h) <= floor(count(*) OVER () * 0.7) THEN 'dev' ELSE 'test' END AS split FROM o",
)
def m4(spark, sf):
    return sm.split_rows(orders(spark, sf), "o_orderkey", 0.7, 42).select("o_orderkey", "split")


@query(
    "m4_split_counts",
    f"WITH {O}, s AS (SELECT o_orderpriority AS c, CASE WHEN row_number() OVER (ORDER BY h) <= floor(count(*) OVER () * 0.7) THEN 'dev' ELSE 'test' END AS split FROM o), g AS (SELECT split, CASE WHEN grouping(c) = 1 THEN 'ALL' ELSE c END AS category, count(*) AS n FROM s GROUP BY GROUPING SETS ((split, c), (split))) SELECT *, n / max(n) OVER (PARTITION BY split) AS share FROM g",
)
def m4_counts(spark, sf):
    split = sm.split_rows(orders(spark, sf), "o_orderkey", 0.7, 42)
    return sm.split_counts(split, "split", "o_orderpriority")


@query(
    "m5_hamilton",
    "WITH g AS (SELECT o_custkey % 13 AS stratum, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT *, sum(n) OVER () AS s FROM g), f AS (SELECT *, (n * 101) // s AS base, row_number() OVER (ORDER BY (n * 101) % s DESC, stratum) AS r FROM t) SELECT stratum, n, CAST(base + CASE WHEN r <= 101 - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM f",
)
def m5(spark, sf):
    return sm.hamilton(strata(spark, sf), "stratum", "n", 101)


def strata(spark, sf):
    return table(spark, sf, "orders").groupBy((F.col("o_custkey") % 13).alias("stratum")).agg(F.count("*").alias("n"))


def capped_rounds(target: str, rounds: int) -> str:
    """CTEs of rounds of largest remainders over s (stratum, n): the first over all strata, the others over those with room."""
    out = f"q0 AS (SELECT stratum, n, CAST(1 AS HUGEINT) AS quota, {target} - count(*) OVER () AS due FROM s)"
    for i in range(rounds):
        free, clamp = ("true", "a.f") if i == 0 else ("quota < n", "least(a.f, n - quota)")
        out += f""",
a{i} AS (SELECT *, CASE WHEN {free} THEN (n * due) // nullif(sum(CASE WHEN {free} THEN n END) OVER (), 0) ELSE 0 END AS f, CASE WHEN {free} THEN (n * due) % nullif(sum(CASE WHEN {free} THEN n END) OVER (), 0) END AS m FROM q{i}),
b{i} AS (SELECT *, quota + coalesce({clamp}, 0) AS w, m IS NOT NULL AND ({'true' if i == 0 else f'quota + coalesce({clamp}, 0) < n'}) AS o FROM a{i} a),
c{i} AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY m DESC, stratum) AS r, due - sum(w - quota) OVER () AS spare FROM b{i}),
d{i} AS (SELECT stratum, n, least(n, w + CASE WHEN o AND r <= spare THEN 1 ELSE 0 END) AS quota FROM c{i}),
q{i + 1} AS (SELECT *, {target} - sum(quota) OVER () AS due FROM d{i})"""
    return out


@query(
    "m6_hamilton_capped",
    f"WITH s AS (SELECT o_custkey % 1009 % 113 AS stratum, count(*) AS n FROM orders WHERE o_custkey % 1009 % 113 < o_orderkey % 113 GROUP BY 1), {capped_rounds('(SELECT sum(n) FROM s) - 25', 8)} SELECT stratum, CAST(quota AS BIGINT) AS quota FROM q8",
)
def m6(spark, sf):
    """All but 25 rows are wanted, so that small strata are full at once and others take what they leave."""
    stratum = F.col("o_custkey") % 1009 % 113
    small = table(spark, sf, "orders").where(
        stratum < F.col("o_orderkey") % 113,
    ).groupBy(stratum.alias("stratum")).agg(F.count("*").alias("n"))
    return sm.hamilton_capped(small, "stratum", "n", small.agg(F.sum("n")).first()[0] - 25)


@query(
    "m7_nested_sample",
    f"WITH {O} SELECT o_orderkey, r <= 10 AS in_small FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY h, o_orderkey) AS r FROM o) WHERE r <= 50",
)
def m7(spark, sf):
    return sm.nested_sample(
        orders(spark, sf),
        ["o_orderpriority"],
        "o_orderkey",
        50,
        10,
        42,
    ).select("o_orderkey", "in_small")


@query(
    "m8_sample_controls",
    f"WITH {O}, g AS (SELECT o_orderpriority, count(*) FILTER (is_augmented) * 5 AS m FROM o GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, is_augmented ORDER BY h, o_orderkey) AS r FROM o JOIN g USING (o_orderpriority)) SELECT o_orderkey, is_augmented FROM r WHERE is_augmented OR r <= m",
)
def m8(spark, sf):
    return sm.sample_controls(
        orders(spark, sf),
        ["o_orderpriority"],
        F.col("is_augmented"),
        "o_orderkey",
        5,
        42,
    ).select("o_orderkey", "is_augmented")


@query(
    "m8_cap_per_class",
    f"WITH {O} SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY h, o_orderkey) AS r FROM o) WHERE r <= 33",
)
def m8_cap(spark, sf):
    return sm.cap_per_class(orders(spark, sf), ["o_orderpriority"], "o_orderkey", 33, 42).select("o_orderkey")
