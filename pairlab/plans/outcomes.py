"""Queries of paired outcomes and statistics. A prompt is an order, a condition a line number (1 the baseline)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlab.operators import outcomes as oc
from pairlab.operators import stats
from pairlab.operators.quantiles import exact_percentiles
from pairlab.registry import query, table

PAIRED = """WITH scans AS (SELECT l_orderkey AS prompt_id, l_linenumber AS method, bool_or(l_returnflag = 'R') AS is_vulnerable, bool_or(l_discount = 0) AS skipped, max(l_quantity) > 1 AS valid, min(l_quantity) AS qty FROM lineitem GROUP BY ALL),
paired AS (SELECT m.*, CAST(m.method AS VARCHAR) AS m, o_orderpriority AS category, o_orderstatus AS language, b.is_vulnerable AS b0_vulnerable, b.skipped AS b0_skipped FROM scans m JOIN scans b ON m.prompt_id = b.prompt_id AND b.method = 1 JOIN orders ON o_orderkey = m.prompt_id WHERE m.method > 1),
f AS (SELECT *, NOT b0_vulnerable AND NOT b0_skipped AS b0_safe, b0_vulnerable AND valid AND NOT skipped AND NOT is_vulnerable AS repaired, NOT b0_vulnerable AND NOT b0_skipped AND NOT skipped AND is_vulnerable AS corrupted, b0_vulnerable AND NOT is_vulnerable AS removed FROM paired)
"""
A5 = "count(*) AS n, count(*) FILTER (b0_vulnerable) AS n_vulnerable, count(*) FILTER (b0_safe) AS n_safe, count(*) FILTER (repaired) AS n_repaired, count(*) FILTER (removed) AS n_removed, count(*) FILTER (corrupted) AS n_corrupted, count(*) FILTER (valid) AS n_valid, count(*) FILTER (is_vulnerable) AS n_raw_vulnerable, count(*) FILTER (NOT skipped) AS n_scanned, count(*) FILTER (skipped) AS n_skipped"
A5_RATES = "n_vulnerable - n_repaired AS n_corrected_vulnerable, n_repaired / nullif(n_vulnerable, 0) AS corr_vrr, 1 - n_raw_vulnerable / nullif(n_vulnerable, 0) AS raw_vrr, n_removed / nullif(n_vulnerable, 0) AS removed_rate, n_corrupted / nullif(n_safe, 0) AS corruption_rate, n_valid / nullif(n, 0) AS validity_rate"


def paired(spark, sf):
    scans = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("prompt_id"), F.col("l_linenumber").alias("method")).agg(
        F.bool_or(F.col("l_returnflag") == "R").alias("is_vulnerable"), F.bool_or(F.col("l_discount") == 0).alias("skipped"), (F.max("l_quantity") > 1).alias("valid"), F.min("l_quantity").alias("qty"))
    both = oc.pair_conditions(scans.where("method = 1"), scans.where("method > 1"), ["prompt_id"])
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("prompt_id"),
        F.col("o_orderpriority").alias("category"),
        F.col("o_orderstatus").alias("language"),
    )
    return both.join(orders, "prompt_id")


def seeded(spark, sf):
    return paired(spark, sf).withColumn("seed", F.col("method"))


@query(
    "j5_pair_conditions",
    PAIRED + "SELECT prompt_id, method, category, language, b0_vulnerable, b0_skipped, is_vulnerable, skipped, valid FROM paired",
)
def j5(spark, sf):
    return paired(spark, sf).drop("qty")


@query(
    "a1_value_counts",
    "SELECT 'l_returnflag' AS \"column\", l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY ALL UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY ALL UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR), count(*) FROM lineitem GROUP BY ALL",
)
def a1(spark, sf):
    return oc.value_counts(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


@query(
    "a2_dataset_stats",
    "SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_orderstatus <> 'P') AS raw, count(*) FILTER (o_orderstatus = 'P') AS augmented, count(*) FILTER (o_orderstatus = 'P') / count(*) AS augmented_fraction FROM orders GROUP BY 1",
)
def a2(spark, sf):
    return oc.dataset_stats(table(spark, sf, "orders"), ["o_orderpriority"], F.col("o_orderstatus") == "P")


@query(
    "a3_stage_counts",
    "SELECT o_orderpriority AS category, count(*) AS \"all\", count(*) FILTER (o_totalprice > 1000) AS filtered, count(*) FILTER (o_totalprice > 1000 AND o_custkey % 5 = 0 AND o_orderpriority <> '5-LOW') AS test FROM orders GROUP BY 1",
)
def a3(spark, sf):
    orders = table(spark, sf, "orders")
    kept = orders.where("o_totalprice > 1000")
    return oc.stage_counts(
        {"all": orders, "filtered": kept, "test": kept.where("o_custkey % 5 = 0 AND o_orderpriority <> '5-LOW'")},
        "o_orderpriority",
    )


@query("a4_method_metrics", PAIRED + """, c AS (SELECT method, count(*) AS n, count(*) FILTER (b0_vulnerable) AS n_vulnerable, count(*) FILTER (NOT b0_vulnerable) AS n_safe, count(*) FILTER (is_vulnerable) AS n_method_vulnerable, count(*) FILTER (skipped) AS n_skipped, count(*) FILTER (NOT b0_vulnerable AND is_vulnerable) AS n_corrupted, count(*) FILTER (valid) AS n_valid,
count(*) FILTER (category < '4' AND NOT valid) AS n_empty, count(*) FILTER (category < '4' AND b0_vulnerable AND NOT valid) AS n_empty_vulnerable FROM f GROUP BY 1)
SELECT *, 1 - n_method_vulnerable / nullif(n_vulnerable, 0) AS vrr, n_corrupted / nullif(n_safe, 0) AS corruption_rate, (n_safe - n_corrupted) / nullif(n_safe, 0) AS safe_to_safe, n_valid / n AS validity_rate, 1 - (n_method_vulnerable + n_empty_vulnerable) / nullif(n_vulnerable, 0) AS corrected_vrr FROM c""")
def a4(spark, sf):
    return oc.method_metrics(paired(spark, sf), ["method"], ["1-URGENT", "2-HIGH", "3-MEDIUM"])


@query("a5_paired_metrics", PAIRED + f", c AS (SELECT method, {A5} FROM f GROUP BY 1) SELECT *, {A5_RATES} FROM c")
def a5(spark, sf):
    return oc.paired_metrics(paired(spark, sf), ["method"])


@query("a5_output_counts", """
WITH t AS (SELECT source, text, CASE doc_id % 5 WHEN 0 THEN 'HOOK_EXCEPTION' WHEN 1 THEN NULL WHEN 2 THEN 'WHITESPACE_ONLY' ELSE 'SUCCESS' END AS s, CASE WHEN doc_id % 7 = 3 THEN 'USED' WHEN doc_id % 7 = 4 THEN 'NONE' END AS f FROM documents)
SELECT source, count(*) AS n, count(*) FILTER (coalesce(text, '') = '') AS n_strict_empty, count(*) FILTER (text <> '' AND NOT regexp_matches(text, '\\S')) AS n_whitespace_only, count(*) FILTER (coalesce(s, '') NOT IN ('SUCCESS', 'WHITESPACE_ONLY')) AS n_failed, count(*) FILTER (s = 'HOOK_EXCEPTION') AS n_hook_failed, count(*) FILTER (f = 'USED') AS n_fallback FROM t GROUP BY 1""")
def a5_outputs(spark, sf):
    i, j = F.col("doc_id") % 5, F.col("doc_id") % 7
    status = F.when(i == 0, "HOOK_EXCEPTION").when(i == 1, F.lit(None)).when(
        i == 2,
        "WHITESPACE_ONLY",
    ).otherwise("SUCCESS")
    made = table(spark, sf, "documents").select(
        "source",
        "text",
        status.alias("status"),
        F.when(j == 3, "USED").when(j == 4, "NONE").alias("fallback"),
    )
    return oc.output_counts(made, ["source"], "text", "status", "fallback")


A6 = """, c AS (SELECT method, category, count(*) AS n, count(*) FILTER (b0_vulnerable) AS n_vulnerable, count(*) FILTER (repaired) AS n_repaired, count(*) FILTER (b0_safe) AS n_safe, count(*) FILTER (corrupted) AS n_corrupted, count(*) FILTER (valid) AS n_valid FROM f GROUP BY ALL),
x AS (SELECT method, category, coalesce(n, 0) AS n, coalesce(n_vulnerable, 0) AS n_vulnerable, coalesce(n_repaired, 0) AS n_repaired, coalesce(n_safe, 0) AS n_safe, coalesce(n_corrupted, 0) AS n_corrupted, coalesce(n_valid, 0) AS n_valid
  FROM (SELECT DISTINCT method FROM f) CROSS JOIN (SELECT DISTINCT o_orderpriority AS category FROM orders UNION ALL SELECT '9-NEVER') LEFT JOIN c USING (method, category)),
y AS (SELECT *, n_repaired / nullif(n_vulnerable, 0) AS vrr, n_corrupted / nullif(n_safe, 0) AS corruption_rate, n_valid / nullif(n, 0) AS validity_rate, CASE WHEN n_vulnerable = 0 THEN 'NOT_ESTIMABLE' WHEN n_vulnerable < 5 THEN 'LOW_SUPPORT' ELSE 'ESTIMABLE' END AS status FROM x)
"""


def categories(spark, sf):
    taxonomy = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("category")).distinct()
    return oc.per_category(
        paired(spark, sf),
        ["method"],
        taxonomy.unionByName(spark.range(1).select(F.lit("9-NEVER").alias("category"))),
    )


@query("a6_per_category", PAIRED + A6 + "SELECT * FROM y")
def a6(spark, sf):
    return categories(spark, sf)


@query(
    "a7_vrr_pivot",
    PAIRED + A6 + "SELECT category, " + ", ".join(
        f"max(vrr) FILTER (method = {m}) AS \"{m}\"" for m in range(2, 8)
    ) + " FROM y GROUP BY 1",
)
def a7(spark, sf):
    return oc.rate_pivot(categories(spark, sf), "category", "method", list(range(2, 8)), "vrr")


@query("a8_seed_summary", PAIRED + f""", c AS (SELECT category, method, {A5} FROM f GROUP BY ALL), r AS (SELECT *, {A5_RATES} FROM c)
SELECT category, count(*) AS n_seeds, round(avg(corr_vrr), 9) AS corr_vrr_mean, round(stddev_samp(corr_vrr), 9) AS corr_vrr_sd, min(corr_vrr) AS corr_vrr_min, max(corr_vrr) AS corr_vrr_max FROM r GROUP BY 1""")
def a8(spark, sf):
    out = oc.seed_summary(oc.paired_metrics(paired(spark, sf), ["category", "method"]), ["category"], ["corr_vrr"])
    return out.withColumns({c: F.round(c, 9) for c in ("corr_vrr_mean", "corr_vrr_sd")})


def wilson_sql(name: str, k: str, n: str) -> str:
    z = stats.Z
    half = f"{z} * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + {z * z} / {n} / {n} / 4) / (1 + {z * z} / {n})"
    middle = f"({k} / {n} + {z * z} / {n} / 2) / (1 + {z * z} / {n})"
    return f"{k} / nullif({n}, 0) AS {name}_rate, CASE WHEN {n} > 0 THEN round({middle} - {half}, 8) END AS {name}_low, CASE WHEN {n} > 0 THEN round({middle} + {half}, 8) END AS {name}_high"


#: The chance of at most the lesser of two counts among their sum, twice, by logarithms of factorials.
SCOPE_P = "CASE WHEN n_repaired + n_regressed = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(least(n_repaired, n_regressed) + 1), lambda i: exp(lgamma(n_repaired + n_regressed + 1) - lgamma(i + 1) - lgamma(n_repaired + n_regressed - i + 1) - (n_repaired + n_regressed) * ln(2))))) END"


@query("a9_scope_summary", PAIRED + f""", g AS (SELECT method AS seed, category, language, CASE WHEN grouping(category) = 1 THEN 'overall' WHEN grouping(language) = 1 THEN 'category' ELSE 'category_language' END AS scope, CASE WHEN grouping(method) = 1 THEN 'ALL' ELSE 'seed' END AS pooling, count(*) AS n,
count(*) FILTER (b0_vulnerable) AS n_vulnerable, count(*) FILTER (repaired) AS n_repaired, count(*) FILTER (b0_vulnerable AND NOT valid) AS n_unsafe_invalid, count(*) FILTER (b0_safe) AS n_safe, count(*) FILTER (corrupted) AS n_corrupted, count(*) FILTER (corrupted AND valid) AS n_regressed, count(*) FILTER (b0_vulnerable <> is_vulnerable) AS n_changed
FROM f GROUP BY GROUPING SETS ((method), (method, category), (method, category, language), (), (category), (category, language)))
SELECT *, {wilson_sql("repair", "n_repaired", "n_vulnerable")}, {wilson_sql("corruption", "n_corrupted", "n_safe")}, {wilson_sql("regression", "n_regressed", "n_safe")}, n_unsafe_invalid / nullif(n_vulnerable, 0) AS unsafe_invalid_rate,
round({SCOPE_P}, 8) AS mcnemar_p, CASE WHEN n_vulnerable > 0 THEN 'EVALUATED' ELSE 'NO_VULNERABLE_BASELINE' END AS status FROM g""")
def a9(spark, sf):
    bounds = [f"{r}_{b}" for r in ("repair", "corruption", "regression") for b in ("low", "high")]
    return oc.scope_summary(seeded(spark, sf)).withColumns({c: F.round(c, 8) for c in (*bounds, "mcnemar_p")})


CELLS = PAIRED + """, s AS (SELECT category, method, prompt_id, CASE WHEN b0_vulnerable THEN 'unsafe' ELSE 'safe' END AS arm, valid, skipped, is_vulnerable AS target_present, is_vulnerable OR skipped AS any_finding FROM paired),
d AS (SELECT category, count(DISTINCT prompt_id) FILTER (arm = 'unsafe') AS n_unsafe, count(DISTINCT prompt_id) FILTER (arm = 'safe') AS n_safe FROM s GROUP BY 1),
c AS (SELECT category, method, count(*) AS n, count(*) FILTER (arm = 'unsafe' AND valid AND NOT target_present) AS n_repaired, count(*) FILTER (arm = 'safe' AND valid AND any_finding) AS n_corrupted, count(*) FILTER (NOT valid) AS n_invalid FROM s GROUP BY ALL),
r AS (SELECT *, n_repaired / nullif(n_unsafe, 0) AS repair_rate, n_corrupted / nullif(n_safe, 0) AS corruption_rate, n_invalid / n AS invalid_rate FROM c LEFT JOIN d USING (category))
"""


def cell_scans(spark, sf):
    return paired(spark, sf).select(
        "category",
        "method",
        "prompt_id",
        F.when(F.col("b0_vulnerable"), "unsafe").otherwise("safe").alias("arm"),
        "valid",
        "skipped",
        F.col("is_vulnerable").alias("target_present"),
        F.expr("is_vulnerable OR skipped").alias("any_finding"),
    )


def cells(spark, sf):
    scans = cell_scans(spark, sf)
    denominators = scans.groupBy("category").agg(
        F.count_distinct(F.when(F.col("arm") == "unsafe", F.col("prompt_id"))).alias("n_unsafe"),
        F.count_distinct(F.when(F.col("arm") == "safe", F.col("prompt_id"))).alias("n_safe"),
    )
    return oc.cell_metrics(scans, ["category", "method"], denominators, ["category"], 0.15, 0.3)


@query(
    "a10_cell_metrics",
    CELLS + "SELECT category, method, n, n_repaired, n_corrupted, n_invalid, n_unsafe, n_safe, repair_rate, corruption_rate, invalid_rate, repair_rate >= 0.15 AND corruption_rate <= 0.3 AS admissible FROM r",
)
def a10(spark, sf):
    return cells(spark, sf)


@query(
    "a10_cell_ids",
    CELLS + "SELECT category, method, prompt_id, CASE WHEN arm = 'unsafe' THEN 'repaired' ELSE 'corrupted' END AS outcome FROM s WHERE valid AND CASE WHEN arm = 'unsafe' THEN NOT target_present ELSE any_finding END",
)
def a10_ids(spark, sf):
    return oc.cell_ids(cell_scans(spark, sf), ["category", "method"])


CANDIDATES = CELLS + """, v AS (SELECT category, method, n, repair_rate, list_sort(list_filter(CASE WHEN method % 2 = 0 THEN ['x', 'y'] ELSE ['x', 'z', 'w'] END, lambda q: q NOT IN ('x', 'z'))) AS new_categories, n <= 50 AS tech,
  (CASE WHEN repair_rate >= 0.15 THEN 0 ELSE 1 END) AS g1, (CASE WHEN corruption_rate <= 0.25 THEN 0 ELSE 1 END) AS g2 FROM r),
w AS (SELECT *, CASE WHEN tech THEN 'technical_failure' WHEN g1 + g2 = 0 THEN 'validated' WHEN g1 + g2 = 1 THEN 'failed_single_gate' ELSE 'failed_multiple_gates' END AS status, concat_ws(',', CASE WHEN tech THEN 'size' END, CASE WHEN g1 = 1 THEN 'repair' END, CASE WHEN g2 = 1 THEN 'corruption' END) AS failed FROM v)
"""


def candidates(spark, sf):
    made = cells(spark, sf).withColumns(
        {
            "steered": F.when(F.col("method") % 2 == 0, F.array(F.lit("x"), F.lit("y"))).otherwise(
                F.array(F.lit("x"), F.lit("z"), F.lit("w")),
            ),
            "base": F.array(F.lit("x"), F.lit("z")),
        },
    )
    return oc.validate_candidates(
        made,
        {"size": F.col("n") > 50},
        {"repair": F.col("repair_rate") >= 0.15, "corruption": F.col("corruption_rate") <= 0.25},
        "steered",
        "base",
    )


@query(
    "a11_validate_candidates",
    CANDIDATES + "SELECT category, method, array_to_string(new_categories, ',') AS new_categories, failed AS failed_gates, status FROM w",
)
def a11(spark, sf):
    return candidates(spark, sf).select(
        "category",
        "method",
        F.array_join("new_categories", ",").alias("new_categories"),
        F.array_join("failed_gates", ",").alias("failed_gates"),
        "status",
    )


@query(
    "a12_candidate_rollup",
    CANDIDATES + "SELECT category, count(*) AS tested, count(*) FILTER (status = 'validated') AS validated, min(repair_rate) AS min_rate, max(repair_rate) AS max_rate, count(*) FILTER (g1 = 1) AS failed_repair, count(*) FILTER (g2 = 1) AS failed_corruption, coalesce(string_agg(CAST(method AS VARCHAR), ',' ORDER BY method) FILTER (status = 'validated'), '') AS validated_ids FROM w GROUP BY 1",
)
def a12(spark, sf):
    return oc.candidate_rollup(
        candidates(spark, sf),
        ["category"],
        "method",
        "repair_rate",
        ["repair", "corruption"],
    ).withColumn("validated_ids", F.array_join("validated_ids", ","))


@query(
    "a13_qualify",
    CELLS + "SELECT category, arm AS population, CASE WHEN NOT valid THEN 'invalid' WHEN skipped THEN 'skipped' WHEN arm = 'unsafe' AND NOT target_present THEN 'target_not_replicated' WHEN arm = 'safe' AND any_finding THEN 'finding_in_safe' ELSE 'qualified' END AS reason, count(*) AS n FROM s GROUP BY ALL",
)
def a13(spark, sf):
    return oc.qualified_counts(cell_scans(spark, sf).withColumnRenamed("arm", "population"), ["category"])


@query("w4_first_boundary", PAIRED + f""", c AS (SELECT category, method, {A5} FROM f GROUP BY ALL), r AS (SELECT *, {A5_RATES} FROM c),
b AS (SELECT category, min(method) FILTER (corruption_rate > 0.21 OR validity_rate < 0.97) AS boundary FROM r GROUP BY 1)
SELECT b.category, b.boundary, concat_ws(',', CASE WHEN x.corruption_rate > 0.21 THEN 'corruption' END, CASE WHEN x.validity_rate < 0.97 THEN 'validity' END) AS reasons, x.corruption_rate - z.corruption_rate AS corruption_change, x.validity_rate - z.validity_rate AS validity_change
FROM b LEFT JOIN r x ON x.category = b.category AND x.method = b.boundary LEFT JOIN r z ON z.category = b.category AND z.method = 2""")
def w4(spark, sf):
    return oc.first_boundary(
        oc.paired_metrics(paired(spark, sf), ["category", "method"]),
        ["category"],
        "method",
        0.21,
        0.97,
        2,
    )


@query("w4_sweep_steps", PAIRED + f""", c AS (SELECT category, method, {A5}, avg(CAST(qty < 3 AS INT)) AS empty_rate, avg(CAST(qty < 6 AS INT)) AS blank_rate FROM f GROUP BY ALL), r AS (SELECT *, {A5_RATES} FROM c)
SELECT x.category, x.method, x.corruption_rate, x.validity_rate, coalesce(x.corruption_rate > 0.21, false) AS corruption_crossed, coalesce(x.validity_rate < 0.97, false) AS validity_crossed, x.empty_rate, x.blank_rate, abs(x.empty_rate - z.empty_rate) AS empty_rate_difference, abs(x.blank_rate - z.blank_rate) AS blank_rate_difference
FROM r x LEFT JOIN r z ON z.category = x.category AND z.method = 4""")
def w4_steps(spark, sf):
    df, keys = paired(spark, sf), ["category", "method"]
    other = df.groupBy(*keys).agg(F.avg((F.col("qty") < 3).cast("int")).alias("empty_rate"), F.avg((F.col("qty") < 6).cast("int")).alias("blank_rate"))
    steps = oc.paired_metrics(df, keys).join(other, keys)
    return oc.sweep_steps(steps, ["category"], "method", 4, ["empty_rate", "blank_rate"], 0.21, 0.97)


@query("w8_seed_consistency", PAIRED + """, e AS (SELECT prompt_id, method, bool_or(repaired) AS r FROM f WHERE b0_vulnerable GROUP BY ALL),
p AS (SELECT prompt_id, """ + ", ".join(f"bool_or(r) FILTER (method = {m}) AS seed_{m}" for m in range(2, 8)) + """, CAST(count(*) FILTER (r) AS INTEGER) AS n_repaired, CAST(count(*) AS INTEGER) AS n_eligible FROM e GROUP BY 1)
SELECT *, CASE WHEN n_repaired = n_eligible THEN 'ALWAYS' WHEN n_repaired = 0 THEN 'NEVER' ELSE 'MIXED' END AS status FROM p""")
def w8(spark, sf):
    return oc.seed_consistency(seeded(spark, sf), "prompt_id", list(range(2, 8)))


@query(
    "w9_changed_cases",
    PAIRED + "SELECT prompt_id, method, CASE WHEN b0_vulnerable THEN 'removed' ELSE 'introduced' END AS direction FROM paired WHERE b0_vulnerable <> is_vulnerable",
)
def w9(spark, sf):
    return oc.changed_cases(paired(spark, sf)).select("prompt_id", "method", "direction")


@query(
    "a17_status_map",
    "SELECT source, array_to_string(list_sort(list(lang || '=' || n)), ',') AS statuses FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY 1",
)
def a17(spark, sf):
    made = oc.status_map(table(spark, sf, "documents"), ["source"], "lang")
    return made.select(
        "source",
        F.array_join(
            F.transform(F.map_entries("statuses"), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string"))),
            ",",
        ).alias("statuses"),
    )


@query(
    "a18_routing_coverage",
    PAIRED + "SELECT method, count(*) AS n, count(*) FILTER (category <> '5-LOW') AS n_supported, count(*) FILTER (category = '5-LOW') AS n_unsupported, count(*) FILTER (category <> '5-LOW' AND NOT skipped) AS n_active, count(*) FILTER (skipped) AS n_fallback, count(*) FILTER (category <> '5-LOW' AND NOT skipped) / count(*) AS active_rate FROM paired GROUP BY 1",
)
def a18(spark, sf):
    return oc.routing_coverage(
        paired(spark, sf).withColumns({"supported": F.col("category") != "5-LOW", "fallback": F.col("skipped")}),
        ["method"],
    )


@query(
    "a19_gate_rate",
    "SELECT event_type, count(*) AS n_steps, count(*) FILTER (value > 50) AS n_gated, count(*) FILTER (value > 50) / count(*) AS gate_rate FROM events GROUP BY 1",
)
def a19(spark, sf):
    """Each log holds at most 1,000 consecutive events of a user."""
    logs = table(spark, sf, "events").groupBy("event_type", "user_id", F.floor(F.col("event_id") / 1000)).agg(
        F.collect_list(F.struct("value", (F.col("value") > 50).alias("gated"))).alias("gate_log"),
    )
    return oc.gate_rate(logs, ["event_type"], "gate_log", "gated")


@query("a20_evidence_table", """
WITH t AS (SELECT o_orderpriority AS category, bool_or(o_orderpriority < '4') AS claimed, count(*) AS n_all, count(*) FILTER (o_orderstatus = 'P') AS n_aug, count(*) FILTER (o_totalprice > 400000) AS n_high FROM orders GROUP BY 1),
e AS (SELECT *, CASE WHEN n_high >= 150 AND n_aug > 0 THEN 'STRONG' WHEN n_high >= 100 THEN 'LIMITED' ELSE 'NONE' END AS evidence FROM t) SELECT *, claimed <> (evidence <> 'NONE') AS mismatch FROM e""")
def a20(spark, sf):
    orders = table(spark, sf, "orders").withColumn("category", F.col("o_orderpriority"))
    count = lambda d: d.groupBy("category").agg(F.count("*").alias("n"))
    taxonomy = orders.groupBy("category").agg(F.bool_or(F.col("category") < "4").alias("claimed"))
    ladder = [("STRONG", F.expr("n_high >= 150 AND n_aug > 0")), ("LIMITED", F.expr("n_high >= 100"))]
    return oc.evidence_table(
        taxonomy,
        {
            "n_all": count(orders),
            "n_aug": count(orders.where("o_orderstatus = 'P'")),
            "n_high": count(orders.where("o_totalprice > 400000")),
        },
        ladder,
        "claimed",
    )


@query(
    "a21_recurrence",
    "SELECT p_size, p_brand, count(DISTINCT split_part(p_type, ' ', 1)) AS n_categories, " + ", ".join(
        f"bool_or(split_part(p_type, ' ', 1) = '{c}') AS \"in_{c}\"" for c in ("PROMO", "ECONOMY", "SMALL")
    ) + " FROM part GROUP BY ALL HAVING count(DISTINCT split_part(p_type, ' ', 1)) >= 2",
)
def a21(spark, sf):
    return oc.recurrence(
        table(spark, sf, "part").withColumn("kind", F.split_part("p_type", F.lit(" "), F.lit(1))),
        ["p_size", "p_brand"],
        "kind",
        ["PROMO", "ECONOMY", "SMALL"],
    )


WILSON = "n_repaired, n_vulnerable, round((p + d / 2) / (1 + d) - z * sqrt(p * (1 - p) / n_vulnerable + d / n_vulnerable / 4) / (1 + d), 9) AS low, round((p + d / 2) / (1 + d) + z * sqrt(p * (1 - p) / n_vulnerable + d / n_vulnerable / 4) / (1 + d), 9) AS high"


@query(
    "q1_wilson",
    PAIRED + f", c AS (SELECT category, method, {A5} FROM f GROUP BY ALL), x AS (SELECT *, n_repaired / n_vulnerable AS p, 1.959963984540054 AS z, 1.959963984540054 * 1.959963984540054 / n_vulnerable AS d FROM c WHERE n_vulnerable > 0) SELECT category, method, {WILSON} FROM x",
)
def q1(spark, sf):
    low, high = stats.wilson("n_repaired", "n_vulnerable")
    return oc.paired_metrics(paired(spark, sf), ["category", "method"]).where("n_vulnerable > 0").select(
        "category",
        "method",
        "n_repaired",
        "n_vulnerable",
        F.round(low, 9).alias("low"),
        F.round(high, 9).alias("high"),
    )


DISCORDANT = PAIRED + ", c AS (SELECT category, method, count(*) FILTER (removed AND prompt_id % 40 = 0) AS b, count(*) FILTER (NOT b0_vulnerable AND is_vulnerable AND prompt_id % 40 = 0) AS c FROM f GROUP BY ALL)"
# lgamma gives the binomial coefficients that the operator builds up term by term.
MCNEMAR = DISCORDANT + """, p AS (SELECT category, method, b, c, CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, CAST(least(b, c) AS BIGINT) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))))) END AS p FROM c)"""


def discordant(spark, sf):
    return paired(spark, sf).groupBy("category", "method").agg(
        F.count_if(F.expr("b0_vulnerable AND NOT is_vulnerable AND prompt_id % 40 = 0")).alias("b"),
        F.count_if(F.expr("NOT b0_vulnerable AND is_vulnerable AND prompt_id % 40 = 0")).alias("c"),
    )


@query(
    "q2_mcnemar_exact",
    DISCORDANT.replace(
        " AND prompt_id % 40 = 0",
        "",
    ) + MCNEMAR[len(DISCORDANT):] + " SELECT category, method, b, c, round(p, 8) AS p FROM p",
)
def q2(spark, sf):
    counts = paired(spark, sf).groupBy("category", "method").agg(
        F.count_if(F.expr("b0_vulnerable AND NOT is_vulnerable")).alias("b"),
        F.count_if(F.expr("NOT b0_vulnerable AND is_vulnerable")).alias("c"),
    )
    return counts.withColumn("p", F.round(stats.mcnemar_exact("b", "c"), 8))


@query(
    "q3_holm",
    PAIRED + ", c AS (SELECT category, method, round(avg(qty), 6) / 1000 AS p FROM paired GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY p) AS r, count(*) OVER (PARTITION BY category) AS m FROM c) SELECT category, method, p, max(least(1.0, (m - r + 1) * p)) OVER (PARTITION BY category ORDER BY r) AS p_holm FROM r",
)
def q3(spark, sf):
    return stats.holm(
        paired(spark, sf).groupBy("category", "method").agg((F.round(F.avg("qty"), 6) / 1000).alias("p")),
        "p",
        ["category"],
    )


@query(
    "q4_percentile7",
    "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.025), 8) AS low, round(quantile_cont(l_extendedprice, 0.975), 8) AS high FROM lineitem GROUP BY 1",
)
def q4(spark, sf):
    wanted = {"low": 0.025, "high": 0.975}
    bounds = exact_percentiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", wanted)
    return bounds.withColumns({c: F.round(c, 8) for c in wanted})


def drawn_sql(units: str, values: list[str], replicates: int) -> str:
    """CTEs from u, which has the values of each unit, to b: sums over the units that each of the replicates draws."""
    text = " || '|' || ".join(f"CAST(CAST({v} AS DOUBLE) AS VARCHAR)" for v in values)
    coefficients = ", ".join(f"('0x' || substr(h, {8 * k + 1}, 8))::BIGINT % {stats.PRIME} AS c{k}" for k in range(4))
    value = "0"
    for k in range(4):
        value = f"(({value}) * i + c{k}) % {stats.PRIME}"
    return f"""u AS ({units}),
nu AS (SELECT count(*) AS n FROM u),
pu AS (SELECT *, row_number() OVER (ORDER BY md5({text})) - 1 AS k FROM u),
bl AS (SELECT r.range AS replicate, o.range AS block, n, md5('42|' || r.range || '|' || o.range) AS h FROM range({replicates}) r, nu, range((SELECT (n - 1) // {stats.DRAWS} + 1 FROM nu)) o),
co AS (SELECT replicate, n, least({stats.DRAWS}, n - block * {stats.DRAWS}) AS m, {coefficients} FROM bl),
dr AS (SELECT replicate, n, c0, c1, c2, c3, unnest(range(m)) AS i FROM co),
po AS (SELECT replicate, ({value}) * n // {stats.PRIME} AS k FROM dr),
b AS (SELECT replicate, count(*) AS n, {", ".join(f"sum({v}) AS {v}" for v in values)} FROM po JOIN pu USING (k) GROUP BY 1)
"""


def bounds(df):
    return df.withColumns({c: F.round(c, 9) for c in ("low", "high")})


@query("q5_paired_bootstrap", PAIRED + ", " + drawn_sql("SELECT CAST(b0_vulnerable AS INT) AS x, CAST(is_vulnerable AS INT) AS y FROM paired WHERE method = 2", ["x", "y"], 10_000)
       + "SELECT 'difference' AS contrast, round(quantile_cont((x - y) / n, 0.025), 9) AS low, round(quantile_cont((x - y) / n, 0.975), 9) AS high, count(*) AS n FROM b")
def q5(spark, sf):
    return bounds(
        stats.paired_bootstrap(
            paired(spark, sf).where("method = 2"),
            F.col("b0_vulnerable").cast("int"),
            F.col("is_vulnerable").cast("int"),
        ),
    )


@query("q5_hashed_bootstrap", PAIRED + """, u AS (SELECT CAST(row_number() OVER (ORDER BY n) - 1 AS BIGINT) AS k, sum(CAST(b0_vulnerable AS BIGINT)) AS a, sum(CAST(is_vulnerable AS BIGINT)) AS b FROM (SELECT *, prompt_id % 97 AS n FROM paired WHERE method = 2) GROUP BY n),
m AS (SELECT count(*) AS n FROM u), d AS (SELECT r.range AS replicate, ('0x' || substr(md5('42|' || r.range || '|' || i.range), 1, 8))::BIGINT % n AS k FROM range(200) r, range(97) i, m)
SELECT replicate, CAST(sum(a) AS BIGINT) AS a, CAST(sum(b) AS BIGINT) AS b FROM d JOIN u USING (k) GROUP BY 1""")
def q5_hashed(spark, sf):
    groups = paired(spark, sf).where("method = 2").groupBy((F.col("prompt_id") % 97).alias("k")).agg(
        F.sum(F.col("b0_vulnerable").cast("long")).alias("a"),
        F.sum(F.col("is_vulnerable").cast("long")).alias("b"),
    )
    return stats.hashed_bootstrap(groups, "k", 97, ["a", "b"], 200, 42)


def bounds_sql(contrasts: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS contrast, round(quantile_cont({x}, 0.025), 9) AS low, round(quantile_cont({x}, 0.975), 9) AS high, count({x}) AS n FROM b" for n, x in contrasts.items()
    )


RATIO_UNITS = "SELECT " + ", ".join(f"CAST(count(*) FILTER (repaired AND method = {m}) AS INT) AS r{m}, CAST(count(*) FILTER (b0_vulnerable AND method = {m}) AS INT) AS v{m}" for m in (2, 3, 4)) + " FROM f GROUP BY prompt_id"
X2, X3, X4 = (f"r{m} / nullif(v{m}, 0)" for m in (2, 3, 4))


@query("q6_ratio_bootstrap", PAIRED + ", " + drawn_sql(RATIO_UNITS, ["r2", "v2", "r3", "v3", "r4", "v4"], 2000) + bounds_sql({"m2": X2, "m2 - m3 and m4": f"{X2} - ({X3} + {X4}) / 2"}))
def q6(spark, sf):
    df = oc.flags(paired(spark, sf))
    at = lambda m: (f"m{m}", F.when(F.col("method") == m, F.col("repaired").cast("int")).otherwise(0), F.when(F.col("method") == m, F.col("b0_vulnerable").cast("int")).otherwise(0))
    return bounds(
        stats.ratio_bootstrap(
            df,
            ["prompt_id"],
            [at(m) for m in (2, 3, 4)],
            {"m2": (["m2"], []), "m2 - m3 and m4": (["m2"], ["m3", "m4"])},
            2000,
        ),
    )


CLUSTER_UNITS = "SELECT CAST(count(*) FILTER (repaired) AS INT) AS r, CAST(count(*) FILTER (b0_vulnerable) AS INT) AS v FROM f GROUP BY prompt_id % 97"


@query("q7_cluster_bootstrap", PAIRED + ", " + drawn_sql(CLUSTER_UNITS, ["r", "v"], 2000) + bounds_sql({"ratio": "r / nullif(v, 0)"}))
def q7(spark, sf):
    df = oc.flags(paired(spark, sf)).withColumn("cluster", F.col("prompt_id") % 97)
    return bounds(
        stats.cluster_bootstrap(
            df,
            ["cluster"],
            F.col("repaired").cast("int"),
            F.col("b0_vulnerable").cast("int"),
            2000,
        ),
    )


#: Sums of repaired and vulnerable records of 97 clusters by method, and which of them 200 replicates draw.
CLUSTERS = PAIRED + """, u AS (SELECT CAST(row_number() OVER (ORDER BY n) - 1 AS BIGINT) AS k, """ + ", ".join(f"count(*) FILTER (repaired AND method = {m}) AS r{m}, count(*) FILTER (b0_vulnerable AND method = {m}) AS v{m}" for m in (2, 3, 4)) + """, count(*) FILTER (repaired) AS r, count(*) FILTER (b0_vulnerable) AS v FROM (SELECT *, prompt_id % 97 AS n FROM f) GROUP BY n),
m AS (SELECT count(*) AS n FROM u), d AS (SELECT r.range AS replicate, ('0x' || substr(md5('42|' || r.range || '|' || i.range), 1, 8))::BIGINT % n AS k FROM range(200) r, range(97) i, m),
b AS (SELECT replicate, """ + ", ".join(f"sum(r{m}) / nullif(sum(v{m}), 0) AS x{m}" for m in (2, 3, 4)) + """, sum(r) / nullif(sum(v), 0) AS x FROM d JOIN u USING (k) GROUP BY 1)
"""


def cluster_draws(spark, sf):
    df = oc.flags(paired(spark, sf))
    counts = [
        F.count_if(F.expr(f"{flag} AND method = {m}")).alias(f"{c}{m}") for m in (2, 3, 4) for c, flag in (
            ("r", "repaired"),
            ("v", "b0_vulnerable"),
        )
    ]
    sums = df.groupBy((F.col("prompt_id") % 97).alias("k")).agg(
        *counts,
        F.count_if("repaired").alias("r"),
        F.count_if("b0_vulnerable").alias("v"),
    )
    return stats.hashed_bootstrap(sums, "k", 97, sums.columns[1:], 200, 42)


@query("q6_hashed_bootstrap", CLUSTERS + bounds_sql({"m2": "x2", "m2 - m3 and m4": "x2 - (x3 + x4) / 2"}))
def q6_hashed(spark, sf):
    x = {m: F.try_divide(f"r{m}", f"v{m}") for m in (2, 3, 4)}
    out = stats.interval(cluster_draws(spark, sf), {"m2": x[2], "m2 - m3 and m4": x[2] - (x[3] + x[4]) / 2})
    return out.withColumns({c: F.round(c, 9) for c in ("low", "high")})


@query("q7_hashed_bootstrap", CLUSTERS + bounds_sql({"ratio": "x"}))
def q7_hashed(spark, sf):
    out = stats.interval(cluster_draws(spark, sf), {"ratio": F.try_divide("r", "v")})
    return out.withColumns({c: F.round(c, 9) for c in ("low", "high")})


@query("q8_utility_deltas", PAIRED + """, j AS (SELECT m.category, m.method AS condition, count(*) AS n, avg(CAST(NOT b.is_vulnerable AS INT)) AS base_rate, avg(CAST(NOT m.is_vulnerable AS INT)) AS rate, count(*) FILTER (NOT m.is_vulnerable AND b.is_vulnerable) AS improved, count(*) FILTER (m.is_vulnerable AND NOT b.is_vulnerable) AS regressed
FROM paired m JOIN paired b ON m.prompt_id = b.prompt_id AND b.method = 2 WHERE m.method > 2 GROUP BY ALL)
SELECT category, CAST(condition AS VARCHAR) AS condition, n, base_rate, rate, improved, regressed, 0.005 AS threshold, rate - base_rate AS delta, CASE WHEN base_rate - rate < 0.005 THEN 'WITHIN_THRESHOLD' ELSE 'DROP_EXCEEDS_THRESHOLD' END AS status FROM j""")
def q8(spark, sf):
    df = paired(spark, sf).select(
        "category",
        F.col("method").cast("string").alias("condition"),
        F.col("prompt_id").alias("task_id"),
        (~F.col("is_vulnerable")).alias("passed"),
    )
    return stats.utility_deltas(
        df,
        ["category"],
        "2",
        df.select("category").distinct().withColumn("threshold", F.lit(0.005)),
    )


@query(
    "q9_admissible",
    PAIRED + f", c AS (SELECT category, method, {A5} FROM f GROUP BY ALL), r AS (SELECT *, {A5_RATES} FROM c), w AS (SELECT category, method, concat_ws('; ', CASE WHEN coalesce(corr_vrr >= 0.7, false) THEN NULL ELSE 'repair' END, CASE WHEN coalesce(corruption_rate <= 0.22, false) THEN NULL ELSE 'corruption' END) AS reason FROM r) SELECT *, reason = '' AS admissible FROM w",
)
def q9(spark, sf):
    metrics = oc.paired_metrics(paired(spark, sf), ["category", "method"])
    return stats.admissible(
        metrics,
        {"repair": F.col("corr_vrr") >= 0.7, "corruption": F.col("corruption_rate") <= 0.22},
    ).select("category", "method", "reason", "admissible")


@query("w3_select_best", PAIRED + f""", c AS (SELECT category, method, {A5} FROM f GROUP BY ALL), r AS (SELECT *, {A5_RATES}, n_vulnerable > 25 AS g FROM c),
k AS (SELECT *, CASE WHEN g THEN row_number() OVER w END AS selection_rank, first_value(corr_vrr) OVER w AS x, first_value(n_corrupted) OVER w AS y FROM r WINDOW w AS (PARTITION BY category, g ORDER BY corr_vrr DESC, n_corrupted, method))
SELECT category, method, selection_rank, coalesce(selection_rank = 1, false) AS selected, CASE WHEN selection_rank > 1 THEN CASE WHEN corr_vrr IS DISTINCT FROM x THEN 'corr_vrr' WHEN n_corrupted IS DISTINCT FROM y THEN 'n_corrupted' ELSE 'method' END END AS losing_field FROM k""")
def w3(spark, sf):
    metrics = oc.paired_metrics(paired(spark, sf), ["category", "method"])
    best = stats.select_best(
        metrics,
        ["category"],
        [("corr_vrr", False), ("n_corrupted", True), ("method", True)],
        F.col("n_vulnerable") > 25,
    )
    return best.select(
        "category",
        "method",
        F.col("selection_rank").cast("long").alias("selection_rank"),
        "selected",
        "losing_field",
    )
