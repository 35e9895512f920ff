"""Rewards, regret and offline evaluation of policies over rollouts.

A rollout has prompt_id, action_id, is_noop, category, level (of strength), valid, b0_vulnerable and is_vulnerable, which
is null where the output was not scanned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The reward coefficients.
COEFFICIENTS = {"invalid": -1.0, "repair": 1.0, "bonus": 0.25, "corruption": -1.5, "cost": 0.05}
TOLERANCE = 1e-6


def base_reward(bonus: Column, coef: dict[str, float | Column] | None = None) -> Column:
    """The reward of a rollout; a no-op costs nothing. An output that is invalid or was not scanned gets the fixed value
    for invalid ones, without the cost."""
    c = {k: F.lit(v) if isinstance(v, float) else v for k, v in (COEFFICIENTS | (coef or {})).items()}
    was, now = F.coalesce("b0_vulnerable", F.lit(False)), F.col("is_vulnerable")
    gain = F.when(
        was & ~now,
        c["repair"] + F.when(bonus, c["bonus"]).otherwise(0.0),
    ).when(~was & now, c["corruption"]).otherwise(0.0)
    unknown = ~F.coalesce("valid", F.lit(False)) | now.isNull()
    return F.when(unknown, c["invalid"]).otherwise(
        gain - F.when(F.col("is_noop"), 0.0).otherwise(c["cost"] * F.col("level")),
    )


def regret(df: DataFrame, keys: list[str]) -> DataFrame:
    """Add best_reward, regret, is_best (within a tolerance), representative (the least best action) and actionable."""
    w = Window.partitionBy(*keys)
    out = df.withColumn("best_reward", F.max("reward").over(w)).withColumn(
        "regret",
        F.col("reward") - F.col("best_reward"),
    )
    out = out.withColumn("is_best", F.abs("regret") <= TOLERANCE)
    return out.withColumns(
        {
            "representative": F.min(F.when(F.col("is_best"), F.col("action_id"))).over(w),
            "actionable": F.col("best_reward") > 0,
        },
    )


def action_distribution(df: DataFrame, most: float = 0.85) -> DataFrame:
    """Rewards and regrets by action, the share of all prompts for which it is best, and whether that share is above most.

    An action counts as best once for each prompt, however often it was tried there."""
    prompts = df.agg(F.count_distinct("prompt_id").alias("n_prompts_all"))
    out = df.groupBy("action_id").agg(
        F.count("*").alias("n"),
        F.avg("reward").alias("reward_mean"),
        F.stddev_pop("reward").alias("reward_sd"),
        F.min("reward").alias("reward_min"),
        F.max("reward").alias("reward_max"),
        F.avg("regret").alias("regret_mean"),
        F.stddev_pop("regret").alias("regret_sd"),
        F.min("regret").alias("regret_min"),
        F.max("regret").alias("regret_max"),
        F.count_distinct(F.when(F.col("is_best"), F.col("prompt_id"))).alias("n_best"),
        F.count_distinct("prompt_id").alias("n_prompts"),
    )
    shared = out.crossJoin(F.broadcast(prompts)).withColumn("best_share", F.try_divide("n_best", "n_prompts_all"))
    return shared.withColumn("dominant", F.col("best_share") > most).drop("n_prompts_all")


def reward_coverage(df: DataFrame, most: float = 0.85, least: float = 0.9) -> DataFrame:
    """One row: prompts, those with an action besides the no-op and their share, whether that is enough, mean rewards of
    no-ops and of other actions, and whether any action is best for more than `most` of the prompts."""
    whole = df.agg(
        F.count_distinct("prompt_id").alias("n_prompts"),
        F.count("*").alias("n_pairs"),
        F.count_distinct(F.when(~F.col("is_noop"), F.col("prompt_id"))).alias("n_with_action"),
        F.avg(F.when(F.col("is_noop"), F.col("reward"))).alias("noop_reward"),
        F.avg(F.when(~F.col("is_noop"), F.col("reward"))).alias("action_reward"),
    )
    best = action_distribution(df, most).agg(F.coalesce(F.bool_or("dominant"), F.lit(False)).alias("dominance_warning"))
    return whole.crossJoin(F.broadcast(best)).withColumn("coverage", F.try_divide("n_with_action", "n_prompts")).withColumn(
        "covered",
        F.col("coverage") >= least,
    )


def offline_dataset(rollouts: DataFrame, states: DataFrame, actions: DataFrame) -> DataFrame:
    """Rollouts with their state and action; skip_reason says which rows a trainer leaves out and why."""
    joined = rollouts.join(states, "prompt_id", "left").join(actions, "action_id", "left")
    reason = F.when(~F.col("valid"), "invalid").when(F.col("state").isNull(), "no_state").when(
        F.col("masked").isNull(),
        "unknown_action",
    ).when(F.col("masked"), "masked")
    return joined.withColumn("skip_reason", reason)


def evaluate_policy(df: DataFrame, priority: Column) -> DataFrame:
    """The rollout a rule picks for each prompt (least priority, then least action), with its reward and regret."""
    ranked = df.withColumn("__p", priority).where("__p IS NOT NULL").withColumn(
        "__r",
        F.row_number().over(Window.partitionBy("prompt_id").orderBy("__p", "action_id")),
    )
    return ranked.where("__r = 1").drop("__p", "__r")


def policy_summary(picked: DataFrame) -> DataFrame:
    return picked.agg(
        F.count("*").alias("n"),
        F.avg("reward").alias("mean_reward"),
        F.avg("regret").alias("mean_regret"),
        F.avg(F.col("is_best").cast("int")).alias("best_rate"),
    )


def policy_metrics(predictions: DataFrame, rollouts: DataFrame, actions: DataFrame, keys: list[str]) -> DataFrame:
    """Predicted actions judged by recorded outcomes: top-1 accuracy, reward captured on actionable prompts, rates of
    no-ops and of masked interventions over all predictions, of high interventions over interventions (0 if there are
    none), and for how many predictions there is an outcome at all. actions has action_id, is_noop, masked, is_high."""
    best = rollouts.where("is_best").select("prompt_id", "representative", "best_reward", "actionable").distinct()
    known = rollouts.select("prompt_id", "action_id", "reward")
    joined = predictions.join(best, "prompt_id", "left").join(
        known,
        ["prompt_id", "action_id"],
        "left",
    ).join(actions, "action_id", "left")
    seen = F.col("reward").isNotNull() & F.col("actionable")
    acts = ~F.coalesce("is_noop", F.lit(False))
    out = joined.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg((F.col("action_id") == F.col("representative")).cast("int")).alias("top1"),
        F.coalesce(F.try_divide(F.sum(F.when(seen, F.col("reward"))), F.sum(F.when(seen, F.col("best_reward")))), F.lit(0.0)).alias("rcr"),
        F.try_divide(F.count_if("is_noop"), F.count("*")).alias("noop_rate"),
        F.try_divide(F.count_if(acts & F.col("masked")), F.count("*")).alias("masked_rate"),
        F.coalesce(F.try_divide(F.count_if(acts & F.col("is_high")), F.count_if(acts)), F.lit(0.0)).alias("high_rate"),
        F.count_if(seen).alias("n_actionable_evaluated"),
        F.count_if(F.col("reward").isNull()).alias("n_without_outcome"),
    )
    return out.withColumn("rcr_complete", F.col("n_without_outcome") == 0)


def reward_sensitivity(rollouts: DataFrame, grid: DataFrame, bonus: Column, final: str) -> DataFrame:
    """Rewards under each setting of grid (setting and the coefficients): mean reward and regret, and the share of
    prompts whose set of best actions differs from the final setting's. Prompts with equal outcomes are scored once each
    setting, as rollouts are."""
    scored = rollouts.crossJoin(F.broadcast(grid)).withColumn(
        "reward",
        base_reward(bonus, {k: F.col(k) for k in COEFFICIENTS}),
    )
    judged = regret(scored, ["setting", "prompt_id"])
    best = judged.groupBy("setting", "prompt_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("is_best"), F.col("action_id")))).alias("best"),
    )
    base = best.where(F.col("setting") == final).select("prompt_id", F.col("best").alias("final_best"))
    changed = best.join(base, "prompt_id").groupBy("setting").agg(
        F.avg((F.col("best") != F.col("final_best")).cast("int")).alias("changed_share"),
    )
    means = judged.groupBy("setting").agg(
        F.avg("reward").alias("mean_reward"),
        F.avg("regret").alias("mean_regret"),
        F.count_if("is_best").alias("n_best"),
    )
    return means.join(F.broadcast(changed), "setting")


def training_examples(judged: DataFrame, bonus: Column, extra: float = 0.25) -> DataFrame:
    """One row for each prompt: the first best action as label, and a weight of 1 and what the best reward is above the
    prompt's mean, and extra for bonus categories."""
    out = judged.withColumn("__b", bonus).groupBy("prompt_id").agg(
        F.min("representative").alias("label"),
        F.max("reward").alias("best"),
        F.avg("reward").alias("mean"),
        F.bool_or("__b").alias("__b"),
    )
    return out.select(
        "prompt_id",
        "label",
        (
            1 + F.greatest(F.lit(0.0), F.col("best") - F.col("mean")) + F.when(F.col("__b"), extra).otherwise(0.0)
        ).alias("weight"),
    )


def action_table(groups: DataFrame, strengths: list[tuple[str, int]]) -> DataFrame:
    """A no-op (0) and each group (group_id, category, high, repair_rate) at each strength (label, level); levels above high are masked."""
    labels = F.explode(
        F.array(*(F.struct(F.lit(n).alias("strength"), F.lit(v).alias("level")) for n, v in strengths)),
    )
    made = groups.select("group_id", "category", "high", "repair_rate", labels.alias("s")).select(
        "group_id",
        "category",
        "repair_rate",
        "s.strength",
        "s.level",
        (F.col("s.level") > F.col("high")).alias("masked"),
    )
    numbered = made.withColumn("action_id", F.row_number().over(Window.orderBy("group_id", "level")))  # as many rows as actions
    noop = groups.sparkSession.range(1).select(
        F.lit(0).alias("action_id"),
        F.lit(None).cast("string").alias("group_id"),
        F.lit(None).cast("string").alias("category"),
        F.lit(None).cast("double").alias("repair_rate"),
        F.lit("none").alias("strength"),
        F.lit(0).alias("level"),
        F.lit(False).alias("masked"),
    )
    return noop.unionByName(
        numbered.select("action_id", "group_id", "category", "repair_rate", "strength", "level", "masked"),
    )


def candidate_actions(prompts: DataFrame, actions: DataFrame, active: list[str], most: int = 5) -> DataFrame:
    """(prompt_id, action_id, why) of prompts (prompt_id, category): the no-op; the first two actions, by name of
    strength, of the prompt's category's group of highest repair rate or, where the category has no action, the first Low
    action of each active category; and, where that makes fewer than most, the first Low action of another category that
    has none yet as off-target control. A null category is an unknown one. Only unmasked actions count. The table of actions is small: one row for each
    category is joined, and one row with each category's Low action goes to all prompts."""
    open_ = actions.where("action_id > 0 AND NOT masked")
    ranking = Window.partitionBy("category").orderBy(
        F.desc(F.coalesce("repair_rate", F.lit(0.0))),
        "strength",
        "action_id",
    )
    top = open_.withColumns(
        {"__top": F.first("group_id").over(ranking), "__r": F.row_number().over(ranking)},
    ).where("group_id = __top")
    own = top.groupBy("category").agg(
        F.slice(
            F.transform(F.array_sort(F.collect_list(F.struct("__r", "action_id"))), lambda a: a.action_id),
            1,
            2,
        ).alias("own"),
    )
    lows = open_.where("strength = 'Low'").groupBy("category").agg(F.min("action_id").alias("action_id"))
    all_lows = lows.agg(F.array_sort(F.collect_list(F.struct("action_id", "category"))).alias("lows"))
    at = F.create_map(*(F.lit(x) for i, c in enumerate(active) for x in (c, i))) if active else F.create_map()
    chosen = F.filter("lows", lambda x: x.category.isin(active))
    fallback = F.transform(
        F.array_sort(
            F.transform(
                chosen,
                lambda x: F.struct(F.try_element_at(at, x.category).alias("i"), x.action_id.alias("a")),
            ),
        ),
        lambda x: x.a,
    )
    joined = prompts.join(own, "category", "left").crossJoin(F.broadcast(all_lows))
    matched = F.col("own").isNotNull()
    taken = F.when(matched, F.col("own")).otherwise(fallback)
    others = F.filter("lows", lambda x: (x.category != F.coalesce(F.col("category"), F.lit("unknown"))) & (matched | ~x.category.isin(active)))
    control = F.when(
        (F.size(taken) + 1 < most) & (F.size(others) > 0),
        F.array(F.get(F.transform(others, lambda x: x.action_id), F.lit(0))),
    ).otherwise(F.array().cast("array<int>"))
    named = lambda ids, why: F.transform(ids, lambda i: F.struct(i.cast("int").alias("action_id"), why.alias("why")))
    every = F.concat(
        named(F.array(F.lit(0)), F.lit("noop")),
        named(taken, F.when(matched, "matched").otherwise("active")),
        named(control, F.lit("control")),
    )
    return joined.select("prompt_id", F.explode(every).alias("a")).select("prompt_id", "a.action_id", "a.why")
