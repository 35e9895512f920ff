"""Queries of rewards and cost: prompts are orders, actions line numbers, methods event types."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlab.operators import cost
from pairlab.operators import rewards as rw
from pairlab.plans.outcomes import PAIRED, paired
from pairlab.registry import query, table

ROLL = PAIRED + """, ro AS (SELECT prompt_id, method - 1 AS action_id, method = 2 AS is_noop, method % 3 AS level, category, language, valid, b0_vulnerable, CASE WHEN NOT skipped THEN is_vulnerable END AS is_vulnerable, b0_vulnerable AND NOT skipped AND NOT is_vulnerable AS repaired, NOT b0_vulnerable AND NOT skipped AND is_vulnerable AS corrupted, skipped, category < '3' AS bonus FROM f),
sc AS (SELECT *, CASE WHEN NOT valid OR skipped THEN -1.0 ELSE CASE WHEN repaired THEN 1.0 + CASE WHEN bonus THEN 0.25 ELSE 0 END WHEN corrupted THEN -1.5 ELSE 0 END - CASE WHEN is_noop THEN 0 ELSE 0.05 * level END END :: DOUBLE AS reward FROM ro),
rg AS (SELECT *, max(reward) OVER w AS best_reward, round(reward - max(reward) OVER w, 9) AS regret FROM sc WINDOW w AS (PARTITION BY prompt_id)), bs AS (SELECT *, abs(regret) <= 1e-6 AS is_best, best_reward > 0 AS actionable FROM rg),
ju AS (SELECT *, min(CASE WHEN is_best THEN action_id END) OVER (PARTITION BY prompt_id) AS representative FROM bs) """


def rollouts(spark, sf):
    """What was skipped has not been scanned: is_vulnerable is null."""
    scanned = F.when(~F.col("skipped"), F.col("is_vulnerable")).alias("is_vulnerable")
    return paired(spark, sf).select(
        "prompt_id",
        (F.col("method") - 1).alias("action_id"),
        (F.col("method") == 2).alias("is_noop"),
        (F.col("method") % 3).alias("level"),
        "category",
        "language",
        "valid",
        "b0_vulnerable",
        scanned,
    )


def judged(spark, sf):
    return rw.regret(rollouts(spark, sf).withColumn("reward", rw.base_reward(F.col("category") < "3")), ["prompt_id"])


def near(df, *cols):
    return df.withColumns({c: F.round(c, 8) for c in cols})


@query("b1_base_reward", ROLL + "SELECT prompt_id, action_id, round(reward, 8) AS reward FROM sc")
def b1(spark, sf):
    return near(
        rollouts(spark, sf).select("prompt_id", "action_id", rw.base_reward(F.col("category") < "3").alias("reward")),
        "reward",
    )


@query(
    "b2_regret",
    ROLL + "SELECT prompt_id, action_id, round(regret, 8) AS regret, round(best_reward, 8) AS best_reward, is_best, representative, actionable FROM ju",
)
def b2(spark, sf):
    return near(judged(spark, sf), "regret", "best_reward").select(
        "prompt_id",
        "action_id",
        "regret",
        "best_reward",
        "is_best",
        "representative",
        "actionable",
    )


SPREAD = ", ".join(f"round({f}({c}), 8) AS {c}_{n}" for c in ("reward", "regret") for n, f in (("mean", "avg"), ("sd", "stddev_pop"), ("min", "min"), ("max", "max")))
BEST = "count(DISTINCT prompt_id) FILTER (is_best)"
PROMPTS = "(SELECT count(DISTINCT prompt_id) FROM ju)"


@query(
    "b3_action_distribution",
    ROLL + f"SELECT action_id, count(*) AS n, {SPREAD}, {BEST} AS n_best, count(DISTINCT prompt_id) AS n_prompts, {BEST} / {PROMPTS} AS best_share, {BEST} / {PROMPTS} > 0.85 AS dominant FROM ju GROUP BY 1",
)
def b3(spark, sf):
    spread = [f"{c}_{n}" for c in ("reward", "regret") for n in ("mean", "sd", "min", "max")]
    return near(rw.action_distribution(judged(spark, sf)), *spread)


@query(
    "b3_reward_coverage",
    ROLL + f"""SELECT count(DISTINCT prompt_id) AS n_prompts, count(*) AS n_pairs, count(DISTINCT prompt_id) FILTER (NOT is_noop) AS n_with_action, round(avg(reward) FILTER (is_noop), 8) AS noop_reward, round(avg(reward) FILTER (NOT is_noop), 8) AS action_reward,
  (SELECT bool_or(b / {PROMPTS} > 0.3) FROM (SELECT {BEST} AS b FROM ju GROUP BY action_id)) AS dominance_warning, count(DISTINCT prompt_id) FILTER (NOT is_noop) / count(DISTINCT prompt_id) AS coverage, count(DISTINCT prompt_id) FILTER (NOT is_noop) / count(DISTINCT prompt_id) >= 0.9 AS covered FROM ju""",
)
def b3_coverage(spark, sf):
    return near(rw.reward_coverage(judged(spark, sf), most=0.3), "noop_reward", "action_reward")


@query(
    "b4_offline_dataset",
    ROLL + "SELECT prompt_id, action_id, CASE WHEN NOT valid THEN 'invalid' WHEN prompt_id % 9 = 0 THEN 'no_state' WHEN action_id = 6 THEN 'unknown_action' WHEN action_id = 4 THEN 'masked' END AS skip_reason FROM ju",
)
def b4(spark, sf):
    states = table(spark, sf, "orders").where("o_orderkey % 9 != 0").select(
        F.col("o_orderkey").alias("prompt_id"),
        F.array("o_totalprice").alias("state"),
    )
    actions = rollouts(spark, sf).select("action_id").distinct().where("action_id != 6").withColumn(
        "masked",
        F.col("action_id") == 4,
    )
    return rw.offline_dataset(judged(spark, sf), states, actions).select("prompt_id", "action_id", "skip_reason")


@query(
    "b5_evaluate_policy",
    ROLL + ", pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY CASE WHEN level = 1 THEN 0 WHEN is_noop THEN 1 ELSE 2 END, action_id) AS r FROM ju) WHERE r = 1) SELECT count(*) AS n, round(avg(reward), 8) AS mean_reward, round(avg(regret), 8) AS mean_regret, round(avg(CAST(is_best AS INT)), 8) AS best_rate FROM pk",
)
def b5(spark, sf):
    priority = F.when(F.col("level") == 1, 0).when(F.col("is_noop"), 1).otherwise(2)
    return near(
        rw.policy_summary(rw.evaluate_policy(judged(spark, sf), priority)),
        "mean_reward",
        "mean_regret",
        "best_rate",
    )


@query("b6_policy_metrics", ROLL + """, pr AS (SELECT o_orderkey AS prompt_id, CAST(o_custkey % 6 + 1 AS INTEGER) AS action_id, o_orderstatus AS policy FROM orders WHERE o_orderkey IN (SELECT prompt_id FROM ju)), be AS (SELECT DISTINCT prompt_id, representative, best_reward, actionable FROM ju WHERE is_best)
SELECT policy, count(*) AS n, round(avg(CAST(pr.action_id = representative AS INT)), 8) AS top1, round(coalesce(sum(CASE WHEN j.reward IS NOT NULL AND be.actionable THEN j.reward END) / sum(CASE WHEN j.reward IS NOT NULL AND be.actionable THEN be.best_reward END), 0), 8) AS rcr, round(count(*) FILTER (pr.action_id = 1) / count(*), 8) AS noop_rate, round(count(*) FILTER (pr.action_id = 4) / count(*), 8) AS masked_rate,
  round(count(*) FILTER (pr.action_id IN (3, 5)) / count(*) FILTER (pr.action_id <> 1), 8) AS high_rate, count(*) FILTER (j.reward IS NOT NULL AND be.actionable) AS n_actionable_evaluated, count(*) FILTER (j.reward IS NULL) AS n_without_outcome, count(*) FILTER (j.reward IS NULL) = 0 AS rcr_complete
FROM pr LEFT JOIN be USING (prompt_id) LEFT JOIN (SELECT prompt_id, action_id, reward FROM ju) j ON j.prompt_id = pr.prompt_id AND j.action_id = pr.action_id GROUP BY 1""")
def b6(spark, sf):
    rolled = judged(spark, sf)
    predictions = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("prompt_id"),
        (F.col("o_custkey") % 6 + 1).cast("int").alias("action_id"),
        F.col("o_orderstatus").alias("policy"),
    ).join(rolled.select("prompt_id").distinct(), "prompt_id", "left_semi")
    actions = spark.range(1, 7).select(
        F.col("id").cast("int").alias("action_id"),
        (F.col("id") == 1).alias("is_noop"),
        (F.col("id") == 4).alias("masked"),
        F.col("id").isin(3, 5).alias("is_high"),
    )
    return near(
        rw.policy_metrics(predictions, rolled.drop("is_noop", "level"), actions, ["policy"]),
        "top1",
        "rcr",
        "noop_rate",
        "masked_rate",
        "high_rate",
    )


GRID = [
    ("final", -1.0, 1.0, 0.25, -1.5, 0.05),
    ("cost_0", -1.0, 1.0, 0.25, -1.5, 0.0),
    ("cost_1", -1.0, 1.0, 0.25, -1.5, 0.5),
    ("bonus_0", -1.0, 1.0, 0.0, -1.5, 0.05),
    ("corruption_0", -1.0, 1.0, 0.25, 0.0, 0.05),
]


@query("b7_reward_sensitivity", ROLL + ", g AS (SELECT * FROM (VALUES " + ", ".join(str(g) for g in GRID) + """) v(setting, ci, cr, cb, cc, ck)),
s7 AS (SELECT setting, prompt_id, action_id, CAST(CASE WHEN NOT valid OR skipped THEN ci ELSE CASE WHEN repaired THEN cr + CASE WHEN bonus THEN cb ELSE 0 END WHEN corrupted THEN cc ELSE 0 END - CASE WHEN is_noop THEN 0 ELSE ck * level END END AS DOUBLE) AS reward FROM ro, g),
t7 AS (SELECT *, reward - max(reward) OVER (PARTITION BY setting, prompt_id) AS regret FROM s7), u7 AS (SELECT setting, prompt_id, string_agg(CAST(action_id AS VARCHAR), ',' ORDER BY action_id) FILTER (abs(regret) <= 1e-6) AS best FROM t7 GROUP BY ALL),
c7 AS (SELECT u7.setting, avg(CAST(u7.best <> z.best AS INT)) AS changed_share FROM u7 JOIN u7 z ON z.setting = 'final' AND z.prompt_id = u7.prompt_id GROUP BY 1)
SELECT setting, round(avg(reward), 8) AS mean_reward, round(avg(regret), 8) AS mean_regret, count(*) FILTER (abs(regret) <= 1e-6) AS n_best, round(max(changed_share), 8) AS changed_share FROM t7 JOIN c7 USING (setting) GROUP BY 1""")
def b7(spark, sf):
    grid = spark.createDataFrame(
        GRID,
        "setting string, invalid double, repair double, bonus double, corruption double, cost double",
    )
    return near(
        rw.reward_sensitivity(rollouts(spark, sf), grid, F.col("category") < "3", "final"),
        "mean_reward",
        "mean_regret",
        "changed_share",
    )


@query(
    "b8_training_examples",
    ROLL + "SELECT prompt_id, min(representative) AS label, round(1 + greatest(0, max(reward) - avg(reward)) + CASE WHEN bool_or(bonus) THEN 0.25 ELSE 0 END, 8) AS weight FROM ju GROUP BY 1",
)
def b8(spark, sf):
    return near(rw.training_examples(judged(spark, sf), F.col("category") < "3"), "weight")


ACTIONS = """acts AS (SELECT 0 AS action_id, NULL AS group_id, NULL AS category, CAST(NULL AS DOUBLE) AS repair_rate, 'none' AS strength, 0 AS level, false AS masked UNION ALL
  SELECT CAST(row_number() OVER (ORDER BY n_name, level) AS INTEGER), n_name, CAST(n_nationkey % 7 AS VARCHAR), (n_nationkey * 37 % 10) / 10, strength, level, level > 1 + n_nationkey % 3 FROM nation, (SELECT * FROM (VALUES ('Low', 1), ('Med', 2), ('High', 3)) v(strength, level)))"""
ACTIVE = ["4", "1", "3"]


def actions(spark, sf):
    groups = table(spark, sf, "nation").select(
        F.col("n_name").alias("group_id"),
        (F.col("n_nationkey") % 7).cast("string").alias("category"),
        (1 + F.col("n_nationkey") % 3).alias("high"),
        (F.col("n_nationkey") * 37 % 10 / 10).alias("repair_rate"),
    )
    return rw.action_table(groups, [("Low", 1), ("Med", 2), ("High", 3)])


@query("j10_action_table", f"WITH {ACTIONS} SELECT * FROM acts")
def j10_table(spark, sf):
    return actions(spark, sf)


@query("j10_candidate_actions", f"""WITH {ACTIONS}, p AS (SELECT c_custkey AS prompt_id, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(c_custkey % 9 AS VARCHAR) END AS category FROM customer), a AS (SELECT * FROM acts WHERE action_id > 0 AND NOT masked),
r AS (SELECT *, first_value(group_id) OVER w AS top, row_number() OVER w AS r FROM a WINDOW w AS (PARTITION BY category ORDER BY repair_rate DESC, strength, action_id)),
o AS (SELECT category, action_id FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY r) AS k FROM r WHERE group_id = top) WHERE k <= 2),
l AS (SELECT category, min(action_id) AS action_id FROM a WHERE strength = 'Low' GROUP BY 1), q AS (SELECT *, coalesce(category, 'unknown') IN (SELECT category FROM a) AS matched FROM p),
t AS (SELECT prompt_id, o.action_id, 'matched' AS why FROM q JOIN o USING (category) UNION ALL SELECT prompt_id, l.action_id, 'active' FROM q, l WHERE NOT matched AND l.category IN ('4', '1', '3')),
n AS (SELECT q.*, (SELECT count(*) FROM t WHERE t.prompt_id = q.prompt_id) AS k FROM q),
x AS (SELECT prompt_id, min(l.action_id) AS action_id FROM n JOIN l ON l.category <> coalesce(n.category, 'unknown') AND (matched OR l.category NOT IN ('4', '1', '3')) WHERE k + 1 < 5 GROUP BY 1)
SELECT prompt_id, 0 AS action_id, 'noop' AS why FROM p UNION ALL SELECT * FROM t UNION ALL SELECT prompt_id, action_id, 'control' FROM x""")
def j10(spark, sf):
    prompts = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("prompt_id"),
        F.when(F.col("c_custkey") % 11 != 0, (F.col("c_custkey") % 9).cast("string")).alias("category"),
    )
    return rw.candidate_actions(prompts, actions(spark, sf), ACTIVE)


TIMED = "WITH t AS (SELECT event_type AS method, dayofmonth(ts) % 3 AS repetition, value, user_id, event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens FROM events) "


def timed(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_type").alias("method"),
        (F.dayofmonth("ts") % 3).alias("repetition"),
        "value",
        "user_id",
        "event_id",
        F.get_json_object("props", "$.k").cast("long").alias("tokens"),
        (F.col("value") < 5).alias("failed"),
        (F.col("value") > 95).alias("fallback"),
    )


@query(
    "a14_latency_summary",
    TIMED + "SELECT method, CASE WHEN grouping(repetition) = 1 THEN 'ALL' ELSE CAST(repetition AS VARCHAR) END AS repetition, count(*) AS n, round(sum(value), 6) AS total, round(avg(value), 8) AS mean, quantile_cont(value, 0.5) AS median, min(value) AS min, max(value) AS max, count(*) FILTER (value < 5) AS failures, count(*) FILTER (value > 95) AS fallbacks FROM t GROUP BY GROUPING SETS ((method, repetition), (method))",
)
def a14(spark, sf):
    return cost.latency_summary(timed(spark, sf), "value", "failed", "fallback").withColumns(
        {"total": F.round("total", 6), "mean": F.round("mean", 8)},
    )


THROUGHPUT = TIMED + ", s AS (SELECT method, count(*) AS n, sum(value) AS seconds, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(user_id % 3) AS BIGINT) AS calls FROM t GROUP BY 1), r AS (SELECT *, tokens / seconds AS tokens_per_second, calls / n AS calls_per_record, seconds / n AS seconds_per_record FROM s)"


@query(
    "a15_throughput",
    THROUGHPUT + " SELECT method, n, round(seconds, 6) AS seconds, tokens, calls, round(tokens_per_second, 8) AS tokens_per_second, calls_per_record, round(seconds_per_record, 8) AS seconds_per_record FROM r",
)
def a15(spark, sf):
    df = cost.throughput(
        timed(spark, sf).withColumn("calls", F.col("user_id") % 3),
        ["method"],
        "value",
        "tokens",
        "calls",
    )
    return near(df, "tokens_per_second", "seconds_per_record").withColumn("seconds", F.round("seconds", 6))


@query(
    "a15_overhead",
    THROUGHPUT + " SELECT method, round(seconds_per_record / b, 8) AS ratio, round((seconds_per_record / b - 1) * 100, 6) AS percent FROM r, (SELECT seconds_per_record AS b FROM r WHERE method = 'click')",
)
def a15_overhead(spark, sf):
    df = cost.throughput(
        timed(spark, sf).withColumn("calls", F.col("user_id") % 3),
        ["method"],
        "value",
        "tokens",
        "calls",
    )
    return cost.overhead(df, "method", "seconds_per_record", "click").select(
        "method",
        F.round("ratio", 8).alias("ratio"),
        F.round("percent", 6).alias("percent"),
    )


STAGED = "WITH l AS (SELECT l_orderkey, l_linenumber, ['draft', 'critique', 'repair', 'extra', 'extra', 'extra', 'extra'][l_linenumber] AS stage, CASE WHEN l_quantity > 2 THEN 'completed' WHEN l_quantity > 1 THEN 'failed' ELSE 'skipped' END AS status, CASE WHEN l_quantity > 1 THEN l_linenumber END AS call, l_tax, CAST(l_quantity AS BIGINT) AS q FROM lineitem)"


def staged(spark, sf):
    names = F.array(*(F.lit(s) for s in ("draft", "critique", "repair", "extra", "extra", "extra", "extra")))
    df = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.element_at(names, F.col("l_linenumber")).alias("stage"),
        F.when(F.col("l_quantity") > 2, "completed").when(F.col("l_quantity") > 1, "failed").otherwise("skipped").alias("status"),
        F.when(F.col("l_quantity") > 1, F.col("l_linenumber")).alias("call"),
        F.col("l_quantity").cast("long").alias("tokens"),
        F.col("l_tax").alias("seconds"),
    )
    return cost.stage_cost(df, ["l_orderkey"], ["draft", "critique", "repair"], "l_linenumber", "completed")


@query(
    "a16_stage_cost",
    STAGED + """, c AS (SELECT coalesce(stage, 'ALL') AS stage, count(*) AS n_rows, count(call) AS calls, CAST(sum(q) AS BIGINT) AS tokens, round(sum(l_tax), 6) AS seconds FROM l GROUP BY GROUPING SETS ((stage), ())),
s AS (SELECT coalesce(stage, 'ALL') AS stage, status, count(*) AS n FROM l GROUP BY GROUPING SETS ((stage, status), (status)))
SELECT c.*, (SELECT string_agg(status || ':' || n, ';' ORDER BY status) FROM s WHERE s.stage = c.stage) AS statuses, coalesce((SELECT sum(n)::BIGINT FROM s WHERE s.stage = c.stage AND status <> 'completed'), 0) AS n_incomplete FROM c""",
)
def a16(spark, sf):
    entries = F.array_sort(F.map_entries("statuses"))
    text = F.array_join(F.transform(entries, lambda e: F.concat_ws(":", e.key, e.value.cast("string"))), ";")
    return staged(spark, sf)[0].withColumns({"seconds": F.round("seconds", 6), "statuses": text})


@query(
    "a16_structural_failures",
    STAGED + ", r AS (SELECT l_orderkey, string_agg(stage, ',' ORDER BY l_linenumber, stage) FILTER (status = 'completed') AS s FROM l GROUP BY 1) SELECT count(*) AS n_records, count(*) FILTER (s IS NULL OR s <> 'draft,critique,repair') AS n_structural_failures FROM r",
)
def a16_failures(spark, sf):
    return staged(spark, sf)[1]
