"""Queries of feature separability over embeddings: entries below zero count as zero, arms are one label against the rest."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlab.operators import features as fx
from pairlab.operators import separability as sp
from pairlab.registry import query, table

LONG = """WITH e AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(64)) AS f FROM embeddings),
cat AS (SELECT DISTINCT label AS category FROM embeddings),
d AS (SELECT category, vec_id, f AS feature_id, label = category AS u, CASE WHEN x > 0 THEN CAST(x AS DOUBLE) ELSE 0 END AS v FROM e, cat),
z AS (SELECT category, count(*) FILTER (label = category) AS nu, count(*) FILTER (label <> category) AS ns FROM embeddings, cat GROUP BY 1)
"""


def in_categories(spark, sf, df):
    """Each row of df for every category there is: the labels of the table, a few."""
    return df.crossJoin(
        F.broadcast(table(spark, sf, "embeddings").select(F.col("label").alias("category")).distinct()),
    )


def long(spark, sf):
    vectors = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("sample_id"),
        "label",
        F.posexplode("embedding").alias("feature_id", "value"),
    ).where("value > 0")
    arm = F.when(F.col("label") == F.col("category"), "unsafe").otherwise("safe")
    return in_categories(spark, sf, vectors).select(
        "category",
        "sample_id",
        F.col("feature_id").cast("long").alias("feature_id"),
        F.col("value").cast("double").alias("value"),
        arm.alias("arm"),
    )


def sizes(spark, sf):
    labels = in_categories(spark, sf, table(spark, sf, "embeddings").select("label"))
    return labels.groupBy("category").agg(
        F.count_if(F.col("label") == F.col("category")).alias("n_unsafe"),
        F.count_if(F.col("label") != F.col("category")).alias("n_safe"),
    )


def entries(spark, sf):
    """Entries above zero with the label of their sample."""
    return table(spark, sf, "embeddings").select(
        F.col("label").alias("category"),
        F.posexplode("embedding").alias("feature_id", "value"),
    ).where("value > 0").select("category", F.col("feature_id").cast("long").alias("feature_id"), "value")


def label_sizes(spark, sf):
    return table(spark, sf, "embeddings").groupBy(F.col("label").alias("category")).agg(F.count("*").alias("n"))


def measured(spark, sf, *measures):
    """Measures of every feature for each label against the rest."""
    return sp.separability(entries(spark, sf), label_sizes(spark, sf), [], "category", measures)


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 8) for c in cols})


KEYS = ["category"]
X1 = "WITH e AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(64)) AS f FROM embeddings), a AS (SELECT label, vec_id, count(*) FILTER (x > 0) AS a FROM e GROUP BY ALL), p AS (SELECT label, count(*) AS n_samples, round(avg(a), 8) AS active_mean, round(stddev_samp(a), 8) AS active_sd, round(1 - avg(a) / 64, 8) AS sparsity FROM a GROUP BY 1), m AS (SELECT label, round(avg(CAST(x AS DOUBLE)), 8) AS magnitude_mean, round(stddev_samp(CAST(x AS DOUBLE)), 8) AS magnitude_sd, CAST(max(x) AS DOUBLE) AS magnitude_max, count(DISTINCT f) AS features_ever_active FROM e WHERE x > 0 GROUP BY 1)"


def stats(spark, sf):
    vectors = table(spark, sf, "embeddings").select("label", F.col("vec_id").alias("sample_id"), "embedding")
    active = vectors.select(
        "label",
        "sample_id",
        F.posexplode("embedding").alias("feature_id", "value"),
    ).where("value > 0").withColumn("value", F.col("value").cast("double"))
    return fx.activation_stats(active, vectors.select("label", "sample_id"), ["label"], 64)


@query("x1_activation_stats", X1 + " SELECT * FROM p JOIN m USING (label)")
def x1(spark, sf):
    return rounded(stats(spark, sf)[0], "active_mean", "active_sd", "sparsity", "magnitude_mean", "magnitude_sd")


@query(
    "x1_top_features",
    X1 + ", t AS (SELECT label, CAST(f AS INTEGER) AS feature_id, count(*) AS n_active FROM e WHERE x > 0 GROUP BY ALL) SELECT label, feature_id, n_active, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n_active DESC, feature_id) AS r FROM t) WHERE r <= 20",
)
def x1_top(spark, sf):
    return stats(spark, sf)[1]


@query(
    "x2_feature_freq",
    LONG + "SELECT category, feature_id, count(*) FILTER (u AND v > 0.05) / max(nu) AS freq_unsafe, count(*) FILTER (NOT u AND v > 0.05) / max(ns) AS freq_safe, round(avg(v) FILTER (u AND v > 0.05), 8) AS magnitude_unsafe, round(avg(v) FILTER (NOT u AND v > 0.05), 8) AS magnitude_safe FROM d JOIN z USING (category) GROUP BY ALL",
)
def x2(spark, sf):
    return rounded(
        sp.feature_freq(entries(spark, sf), label_sizes(spark, sf), [], "category", 0.05),
        "magnitude_unsafe",
        "magnitude_safe",
    ).drop("mean")


HIST = """, r AS (SELECT category, feature_id, min(v) AS lo, max(v) AS hi FROM d GROUP BY ALL),
b AS (SELECT category, feature_id, least(floor((v - lo) / (hi - lo) * 20), 19) AS bin, count(*) FILTER (u) AS cu, count(*) FILTER (NOT u) AS cs FROM d JOIN r USING (category, feature_id) GROUP BY ALL),
h AS (SELECT category, feature_id, 1 - sum(least(cu / nu, cs / ns)) AS hist_dist FROM b JOIN z USING (category) GROUP BY ALL),
mu AS (SELECT category, feature_id, abs(coalesce(sum(v) FILTER (u), 0) / max(nu) - coalesce(sum(v) FILTER (NOT u), 0) / max(ns)) AS delta_mu FROM d JOIN z USING (category) GROUP BY ALL),
c AS (SELECT category, feature_id, v, count(*) FILTER (u) AS cu, count(*) FILTER (NOT u) AS cs FROM d GROUP BY ALL),
k AS (SELECT category, feature_id, max(abs(fu / nu - fs / ns)) AS ks_stat FROM (SELECT category, feature_id, sum(cu) OVER w AS fu, sum(cs) OVER w AS fs FROM c WINDOW w AS (PARTITION BY category, feature_id ORDER BY v)) JOIN z USING (category) GROUP BY ALL)
"""


@query("x3_hist_distance", LONG + HIST + "SELECT category, feature_id, round(hist_dist, 8) AS hist_dist FROM h")
def x3(spark, sf):
    return rounded(measured(spark, sf, "hist_dist"), "hist_dist")


@query("x4_mean_diff", LONG + HIST + "SELECT category, feature_id, round(delta_mu, 8) AS delta_mu FROM mu")
def x4(spark, sf):
    return rounded(measured(spark, sf, "delta_mu"), "delta_mu")


@query("x5_ks_stat", LONG + HIST + "SELECT category, feature_id, round(ks_stat, 8) AS ks_stat FROM k")
def x5(spark, sf):
    return rounded(measured(spark, sf, "ks_stat"), "ks_stat")


RANKED = LONG + HIST + """, p AS (SELECT *, 0.4 * hist_dist + 0.4 * delta_mu AS partial FROM h JOIN mu USING (category, feature_id)), q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY round(partial, 10) DESC, feature_id) AS r FROM p) WHERE r <= 30),
s AS (SELECT q.category, q.feature_id, hist_dist, delta_mu, ks_stat, round(partial + 0.2 * ks_stat, 8) AS score FROM q JOIN k USING (category, feature_id)) """


def ranked(spark, sf):
    return sp.rank_features(measured(spark, sf, "hist_dist", "delta_mu", "ks_stat"), KEYS, preselect=30, keep=15)


@query(
    "x6_rank_features",
    RANKED + "SELECT category, feature_id, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, feature_id) AS r FROM s) WHERE r <= 15",
)
def x6(spark, sf):
    return rounded(ranked(spark, sf), "score").select("category", "feature_id", "score", "rank")


def reasons_sql(high: str) -> str:
    return f"concat_ws(';', CASE WHEN fu < 0.4 THEN 'freq_unsafe' END, CASE WHEN {high} THEN 'both_high' END, CASE WHEN feature_id % 13 NOT IN (5, 6) AND delta_mu < 0.01 THEN 'score' END, CASE WHEN feature_id % 13 IN (5, 6) THEN 'nan_inf_score' END, CASE WHEN mm > 1e4 THEN 'extreme_magnitude' END)"


PRUNED = LONG + HIST + f""", q AS (SELECT category, feature_id, count(*) FILTER (u AND v > 0) / max(nu) AS fu, count(*) FILTER (NOT u AND v > 0) / max(ns) AS fs, avg(v) * max(CASE WHEN feature_id % 17 = 3 THEN 1e9 ELSE 1 END) AS mm FROM d JOIN z USING (category) GROUP BY ALL), t AS (SELECT q.*, delta_mu FROM q JOIN mu USING (category, feature_id)),
w AS (SELECT category, feature_id, {reasons_sql('fu > 0.5 AND fs > 0.5')} AS reasons_and, {reasons_sql('fu > 0.5 OR fs > 0.5')} AS reasons_or FROM t) """


@query("x7_prune", PRUNED + "SELECT *, reasons_and = '' AS keep_and, reasons_or = '' AS keep_or FROM w")
def x7(spark, sf):
    """Scores of every 13th feature are no numbers and magnitudes of every 17th are extreme, so that each rule has cases."""
    freq = sp.feature_freq(entries(spark, sf), label_sizes(spark, sf), [], "category")
    both = freq.join(measured(spark, sf, "delta_mu"), ["category", "feature_id"])
    i = F.col("feature_id")
    both = both.withColumns(
        {
            "score": F.when(i % 13 == 5, float("nan")).when(i % 13 == 6, float("inf")).otherwise(F.col("delta_mu")),
            "mean_magnitude": F.col("mean") * F.when(i % 17 == 3, 1e9).otherwise(1.0),
        },
    )
    first = fx.prune(both, fx.prune_rules(0.4, 0.5, 0.01)).withColumnsRenamed(
        {"reasons": "reasons_and", "keep": "keep_and"},
    )
    second = fx.prune(first, fx.prune_rules(0.4, 0.5, 0.01, either=True)).withColumnsRenamed(
        {"reasons": "reasons_or", "keep": "keep_or"},
    )
    return second.select("category", "feature_id", "reasons_and", "keep_and", "reasons_or", "keep_or")


@query("x8_weight_sensitivity", LONG + HIST + """, w AS (SELECT * FROM (VALUES ('W1', 0.4, 0.4, 0.2), ('W2', 1.0, 0.0, 0.0), ('W3', 0.0, 1.0, 0.0), ('W4', 0.0, 0.0, 1.0), ('W5', 0.2, 0.2, 0.6)) v(weight_id, a, b, c)),
s AS (SELECT weight_id, category, feature_id, round(a * round(hist_dist, 8) + b * round(delta_mu, 8) + c * round(ks_stat, 8), 9) AS x FROM h JOIN mu USING (category, feature_id) JOIN k USING (category, feature_id), w)
SELECT weight_id, category, feature_id, CAST(row_number() OVER (PARTITION BY weight_id, category ORDER BY x DESC, feature_id) AS INTEGER) AS rank FROM s""")
def x8(spark, sf):
    wanted = ("hist_dist", "delta_mu", "ks_stat")
    scores = rounded(measured(spark, sf, *wanted), *wanted)
    weights = spark.createDataFrame(
        [
            ("W1", 0.4, 0.4, 0.2),
            ("W2", 1.0, 0.0, 0.0),
            ("W3", 0.0, 1.0, 0.0),
            ("W4", 0.0, 0.0, 1.0),
            ("W5", 0.2, 0.2, 0.6),
        ],
        "weight_id string, w_hist double, w_mu double, w_ks double",
    )
    return fx.weight_sensitivity(scores, weights, KEYS).select("weight_id", "category", "feature_id", "rank")


AUC = LONG + HIST + ", au AS (SELECT category, feature_id, sum(cu * (coalesce(below, 0) + cs / 2)) / max(nu * ns) AS auc FROM (SELECT *, sum(cs) OVER (PARTITION BY category, feature_id ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM c) JOIN z USING (category) GROUP BY ALL) "


@query("x9_auc", AUC + "SELECT category, feature_id, round(auc, 8) AS auc FROM au")
def x9(spark, sf):
    return rounded(measured(spark, sf, "auc"), "auc")


@query("x10_mutual_info", LONG + """, a AS (SELECT category, feature_id, min(v) AS lo, max(v) AS hi FROM d WHERE v > 0 GROUP BY ALL),
b AS (SELECT category, feature_id, CASE WHEN v > 0 THEN CASE WHEN hi > lo THEN least(floor((v - lo) / (hi - lo) * 10), 9) ELSE 0 END ELSE -1 END AS bin, count(*) FILTER (u) AS cu, count(*) FILTER (NOT u) AS cs FROM d JOIN a USING (category, feature_id) GROUP BY ALL)
SELECT category, feature_id, round(sum(CASE WHEN cu > 0 THEN cu / (nu + ns) * ln(cu * (nu + ns) / ((cu + cs) * nu)) ELSE 0 END + CASE WHEN cs > 0 THEN cs / (nu + ns) * ln(cs * (nu + ns) / ((cu + cs) * ns)) ELSE 0 END), 8) AS mi FROM b JOIN z USING (category) GROUP BY ALL""")
def x10(spark, sf):
    return rounded(fx.mutual_info(long(spark, sf), sizes(spark, sf), KEYS), "mi")


@query("x10_neighbour_info", LONG + """, p AS (SELECT category, feature_id, list(v) AS every, list(v) FILTER (u) AS mine, list(v) FILTER (NOT u) AS others FROM d GROUP BY ALL),
q AS (SELECT category, feature_id, every, t.s AS s, least(3, len(t.s) - 1) AS k, unnest(t.s) AS v FROM p, (SELECT unnest([mine, others]) AS s) t WHERE len(t.s) > 1),
r AS (SELECT *, list_sort(list_transform(s, lambda x: abs(x - v)))[k + 1] AS dist FROM q),
m AS (SELECT category, feature_id, k, len(s) AS side, CASE WHEN dist > 0 THEN len(list_filter(every, lambda x: abs(x - v) < dist)) ELSE len(list_filter(every, lambda x: x = v)) END AS m FROM r),
h AS (SELECT range + 1 AS i, coalesce(sum(1 / range) FILTER (range > 0) OVER (ORDER BY range), 0) - 0.5772156649015329 AS psi FROM range((SELECT count(*) + 1 FROM embeddings)))
SELECT category, feature_id, round(greatest(0, max(hn.psi) + avg(hk.psi) - avg(hs.psi) - avg(hm.psi)), 8) + 0 AS mi FROM (SELECT *, count(*) OVER (PARTITION BY category, feature_id) AS n FROM m) JOIN h hn ON hn.i = n JOIN h hk ON hk.i = k JOIN h hs ON hs.i = side JOIN h hm ON hm.i = m GROUP BY ALL""")
def x10_neighbours(spark, sf):
    """By nearest neighbours, as against x10_mutual_info's bins."""
    found = sp.neighbour_information(entries(spark, sf), label_sizes(spark, sf), [], "category")
    return found.withColumn("mi", F.round("mi", 8) + F.lit(0.0))


SEM = AUC + """, n AS (SELECT feature_id, CAST(feature_id % 3 AS VARCHAR) AS validated, arg_max(CAST(category AS VARCHAR), (auc, CAST(category AS VARCHAR))) AS primary_category, max(auc) AS primary_auc FROM (SELECT category, feature_id, round(auc, 8) AS auc FROM au) GROUP BY ALL),
sem AS (SELECT n.*, primary_category = validated AS category_match, CASE WHEN primary_auc >= 0.55 THEN primary_category ELSE validated END AS assigned_category, (feature_id * 37 % 100) / 100 AS repair_rate, (feature_id * 13 % 40) / 100 AS corrupt_rate,
  coalesce((SELECT string_agg(CAST(category AS VARCHAR), ',' ORDER BY category) FROM au WHERE au.feature_id = n.feature_id AND round(auc, 8) >= 0.55 AND CAST(category AS VARCHAR) <> primary_category), '') AS cross_categories FROM n) """


def semantics(spark, sf):
    aucs = rounded(measured(spark, sf, "auc"), "auc").select(
        "feature_id",
        F.col("category").cast("string").alias("category"),
        "auc",
        (F.col("feature_id") % 3).cast("string").alias("validated"),
    )
    tags = aucs.select("category").distinct().withColumn(
        "tags",
        F.array(F.concat(F.lit("tag"), "category"), F.lit("all")),
    )
    sem = fx.assign_semantics(aucs, ["feature_id"], tags, "validated")
    return sem.withColumns(
        {
            "repair_rate": (F.col("feature_id") * 37 % 100) / 100,
            "corrupt_rate": (F.col("feature_id") * 13 % 40) / 100,
        },
    )


@query(
    "x11_assign_semantics",
    SEM + "SELECT feature_id, validated, primary_category, primary_auc, category_match, assigned_category, cross_categories, 'tag' || assigned_category || ',all' AS tags FROM sem",
)
def x11(spark, sf):
    return semantics(spark, sf).select(
        "feature_id",
        "validated",
        "primary_category",
        "primary_auc",
        "category_match",
        "assigned_category",
        F.array_join("cross_categories", ",").alias("cross_categories"),
        F.array_join("assigned_tags", ",").alias("tags"),
    )


@query("x12_build_groups", SEM + """, t AS (SELECT 'B' AS group_type, *, row_number() OVER (PARTITION BY validated ORDER BY primary_auc DESC, feature_id) AS r FROM sem WHERE category_match AND primary_auc >= 0.55 UNION ALL SELECT 'C', *, row_number() OVER (PARTITION BY validated ORDER BY repair_rate DESC, feature_id) FROM sem WHERE repair_rate >= 0.7 AND corrupt_rate <= 0.1 UNION ALL SELECT 'A', *, row_number() OVER (PARTITION BY validated ORDER BY repair_rate DESC, feature_id) FROM sem)
SELECT validated || '-' || group_type AS group_id, string_agg(CAST(feature_id AS VARCHAR), ',' ORDER BY r) AS feature_ids, round(avg(repair_rate), 8) AS repair_rate, round(avg(corrupt_rate), 8) AS corruption_rate, avg(CAST(category_match AS INT)) AS semantic_purity, round(avg(primary_auc), 7) AS avg_auc, array_to_string(list_sort(list_distinct(flatten(list(['tag' || assigned_category, 'all'])))), ',') AS tags FROM t WHERE r <= 5 GROUP BY validated, group_type""")
def x12(spark, sf):
    g = fx.build_groups(semantics(spark, sf), ["validated"])
    return g.select(
        "group_id",
        F.array_join("feature_ids", ",").alias("feature_ids"),
        F.round("repair_rate", 8).alias("repair_rate"),
        F.round("corruption_rate", 8).alias("corruption_rate"),
        "semantic_purity",
        F.round("avg_auc", 7).alias("avg_auc"),
        F.array_join("tags", ",").alias("tags"),
    )


def groups(spark, sf):
    return sizes(spark, sf).select("category").select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("g")).select(
        F.concat_ws("-", F.col("category").cast("string"), F.col("g").cast("string")).alias("group_id"),
        "category",
        F.transform(
            F.sequence(F.lit(0), F.lit(4)),
            lambda i: (i * 3 + F.col("g") * 20).cast("long"),
        ).alias("feature_ids"),
    )


@query("x13_repair_proxy", LONG + """, g AS (SELECT category, k, category || '-' || k AS group_id, i * 3 + k * 20 AS feature_id FROM cat, (SELECT unnest([0, 1]) AS k), (SELECT unnest(range(5)) AS i)),
t AS (SELECT category, feature_id, avg(v) FILTER (NOT u) + stddev_samp(v) FILTER (NOT u) AS t FROM d GROUP BY ALL), s AS (SELECT d.category, d.feature_id, avg(CAST(v > t AS INT)) AS share FROM d JOIN t USING (category, feature_id) WHERE u GROUP BY ALL)
SELECT group_id, round(avg(share), 8) AS repair_proxy FROM g JOIN s USING (category, feature_id) GROUP BY 1""")
def x13(spark, sf):
    return rounded(sp.repair_proxy(entries(spark, sf), label_sizes(spark, sf), [], groups(spark, sf), "category"), "repair_proxy")


@query("x14_group_stability", LONG + HIST + """, gr AS (SELECT category, category || '-' || k AS group_id, i AS pos, i * 3 + k * 20 AS feature_id FROM cat, (SELECT unnest([0, 1]) AS k), (SELECT unnest(range(5)) AS i)),
ra AS (SELECT category, vec_id, row_number() OVER (PARTITION BY category ORDER BY md5('42|' || vec_id), vec_id) - 1 AS i FROM (SELECT DISTINCT category, vec_id FROM d WHERE u AND v > 0)),
dr AS (SELECT category, r.range AS r, ('0x' || substr(md5('42|' || r.range || '|' || j.range), 1, 15))::BIGINT % nu AS i FROM z, range(50) r, range((SELECT max(nu) FROM z)) j WHERE nu >= 2 AND j.range < greatest(2, floor(nu * 0.8))),
sc AS (SELECT category, feature_id, v, 2 * coalesce(sum(cs) OVER (PARTITION BY category, feature_id ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + cs AS s FROM c),
au2 AS (SELECT group_id, r, pos, sum(s) / (2 * max(ns) * count(*)) AS auc FROM dr JOIN gr USING (category) LEFT JOIN ra USING (category, i) LEFT JOIN d ON d.category = dr.category AND d.vec_id = ra.vec_id AND d.feature_id = gr.feature_id JOIN sc ON sc.category = dr.category AND sc.feature_id = gr.feature_id AND sc.v = coalesce(d.v, 0) JOIN z ON z.category = dr.category GROUP BY ALL),
ar AS (SELECT group_id, r, list_transform(list_sort(list((-auc, -pos)))[:4], lambda t: -t[2]) AS top, avg(auc) AS m FROM au2 GROUP BY ALL),
rk AS (SELECT x.group_id, x.r, x.pos, count(*) FILTER (y.auc < x.auc) + (count(*) FILTER (y.auc = x.auc) + 1) / 2 - 3 AS q FROM au2 x JOIN au2 y ON x.group_id = y.group_id AND x.r = y.r GROUP BY ALL),
pj AS (SELECT x.group_id, avg(len(list_intersect(x.top, y.top)) / len(list_distinct(list_concat(x.top, y.top)))) AS j FROM ar x JOIN ar y ON x.group_id = y.group_id AND x.r < y.r AND y.r < 20 GROUP BY 1),
pc AS (SELECT group_id, avg(c) AS c FROM (SELECT x.group_id, x.r, y.r AS r2, sum(x.q * y.q) / nullif(sqrt(sum(x.q * x.q) * sum(y.q * y.q)), 0) AS c FROM rk x JOIN rk y ON x.group_id = y.group_id AND x.pos = y.pos AND x.r < y.r AND y.r < 20 GROUP BY ALL) GROUP BY 1),
fa AS (SELECT group_id, avg(a.auc) AS auc FROM gr JOIN (SELECT category, feature_id, sum(cu * (coalesce(below, 0) + cs / 2)) / max(nu * ns) AS auc FROM (SELECT *, sum(cs) OVER (PARTITION BY category, feature_id ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM c) JOIN z USING (category) GROUP BY ALL) a USING (category, feature_id) GROUP BY 1),
ra2 AS (SELECT DISTINCT group_id, (category * 7 + 3) % 10 / 10 AS repair_rate, (category * 3) % 10 / 25 AS corruption_rate, category % 4 = 1 AS exempt FROM gr)
SELECT group_id, round((SELECT avg(m) FROM ar WHERE ar.group_id = pj.group_id), 8) AS auc_mean, round(j, 8) AS jaccard, round(coalesce(c, 0.5), 8) AS rank_corr, repair_rate, corruption_rate, round(auc, 8) AS auc, round(auc, 9) >= 0.52 OR exempt AS auc_ok,
  repair_rate > 0.1 AND corruption_rate <= 0.2 AND (round(auc, 9) >= 0.52 OR exempt) AND round(j, 9) >= 0.5 AND round(coalesce(c, 0.5), 9) >= 0.5 AS deployable FROM pj JOIN pc USING (group_id) JOIN fa USING (group_id) JOIN ra2 USING (group_id)""")
def x14(spark, sf):
    made = groups(spark, sf)
    scored = made.select("group_id", "category", F.explode("feature_ids").alias("feature_id")).join(
        measured(spark, sf, "auc"),
        ["category", "feature_id"],
        "left",
    ).groupBy("group_id").agg(F.avg(F.coalesce("auc", F.lit(0.5))).alias("auc"))
    rated = made.join(scored, "group_id").withColumns(
        {
            "repair_rate": (F.col("category") * 7 + 3) % 10 / 10,
            "corruption_rate": (F.col("category") * 3) % 10 / 25,
            "exempt": F.col("category") % 4 == 1,
        },
    )
    return rounded(
        fx.group_stability(long(spark, sf), sizes(spark, sf), KEYS, rated, least_repair=0.1, least_auc=0.52),
        "auc_mean",
        "jaccard",
        "rank_corr",
        "auc",
    )


@query("x15_direction_vectors", LONG.replace("CASE WHEN x > 0 THEN CAST(x AS DOUBLE) ELSE 0 END AS v", "CAST(x AS DOUBLE) AS v") + """, f AS (SELECT category, feature_id, avg(v) FILTER (u) - avg(v) FILTER (NOT u) AS q FROM d GROUP BY ALL), n AS (SELECT category, sqrt(sum(q * q)) AS norm FROM f GROUP BY 1)
SELECT category, CAST(feature_id AS INTEGER) AS dim, round(q / norm * (SELECT avg(norm) FROM n), 8) AS direction, round(norm, 8) AS norm FROM f JOIN n USING (category)""")
def x15(spark, sf):
    samples = in_categories(spark, sf, table(spark, sf, "embeddings").select("embedding", "label")).select(
        "category",
        F.lit(1).alias("layer"),
        "embedding",
        F.when(F.col("label") == F.col("category"), "unsafe").otherwise("safe").alias("arm"),
    )
    return rounded(
        fx.direction_vectors(samples, ["layer", "category"], "layer", "embedding"),
        "direction",
        "norm",
    ).drop("layer")


STATES = """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS f, md5('42|' || unnest(range(64)) || '|0') AS h FROM embeddings WHERE vec_id % 7 <> 3),
a AS (SELECT * FROM e WHERE v > 0), j AS (SELECT range AS j FROM range(32)),
p AS (SELECT vec_id, j, sum(v * (1 - 2 * ((('0x' || substr(h, 1, 8))::BIGINT >> j) & 1))) AS z FROM a, j GROUP BY ALL), n AS (SELECT vec_id, sqrt(sum(z * z)) AS n FROM p GROUP BY 1),
g AS (SELECT * FROM (VALUES (0, [0, 1, 2]), (1, [10, 20, 30, 40])) v(g, ids)),
q AS (SELECT m.vec_id, g, [coalesce(max(v), 0), coalesce(sum(v), 0) / max(len(ids)), count(v) / max(len(ids))] AS s FROM embeddings m CROSS JOIN g LEFT JOIN a ON a.vec_id = m.vec_id AND list_contains(ids, f) GROUP BY ALL),
s AS (SELECT m.vec_id, j AS pos, coalesce(z / n, 0) AS value FROM embeddings m CROSS JOIN j LEFT JOIN p USING (vec_id, j) LEFT JOIN n USING (vec_id)
  UNION ALL SELECT vec_id, 32 + k.range, CASE WHEN k.range < 5 THEN label = k.range WHEN k.range = 5 THEN label IN (5, 6) ELSE label > 6 END::INT FROM embeddings, range(7) k
  UNION ALL SELECT vec_id, 39 + 3 * g + k.range, s[k.range + 1] FROM q, range(3) k)
SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(value, 8) + 0 AS value, vec_id % 7 <> 3 AS known FROM s"""


@query("x16_build_states", STATES)
def x16(spark, sf):
    """Every seventh sample has no entries."""
    active = table(spark, sf, "embeddings").where("vec_id % 7 != 3").select(
        "vec_id",
        F.lit(1).alias("layer"),
        F.posexplode("embedding").alias("feature_id", "value"),
    ).where("value > 0")
    states = fx.build_states(
        table(spark, sf, "embeddings"),
        active,
        "vec_id",
        "label",
        [str(i) for i in range(5)],
        ["5", "6"],
        [(1, [0, 1, 2]), (1, [10, 20, 30, 40])],
        1,
        32,
    )
    return states.select("vec_id", "known", F.posexplode("state").alias("pos", "value")).withColumn("value", F.round("value", 8) + F.lit(0.0))


RECON = "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x, list_transform(embedding, lambda v: CASE WHEN CAST(v AS DOUBLE) > 0.05 THEN round(CAST(v AS DOUBLE), 1) ELSE 0.0 END) AS y FROM embeddings), q AS (SELECT vec_id, label, x, y, list_sum(list_transform(list_zip(x, y), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS er, list_sum(list_transform(x, lambda v: v * v)) AS xx, list_sum(list_transform(y, lambda v: v * v)) AS yy, list_sum(list_transform(list_zip(x, y), lambda p: p[1] * p[2])) AS xy, len(list_filter(y, lambda v: v <> 0)) AS l0 FROM e) "


def recon(spark, sf):
    return table(spark, sf, "embeddings").select(
        "vec_id",
        "label",
        F.transform("embedding", lambda v: v.cast("double")).alias("x"),
        F.transform(
            "embedding",
            lambda v: F.when(v.cast("double") > 0.05, F.round(v.cast("double"), 1)).otherwise(0.0),
        ).alias("y"),
    )


@query(
    "x17_reconstruction_metrics",
    RECON + "SELECT vec_id, round(sqrt(er) / nullif(sqrt(xx), 0), 8) AS relative_l2, round(er / 64, 8) AS mse, CAST(l0 AS INTEGER) AS l0, l0 / 64 AS active_fraction, round(xy / nullif(sqrt(xx) * sqrt(yy), 0), 8) AS cosine FROM q",
)
def x17(spark, sf):
    return rounded(
        fx.reconstruction_metrics(recon(spark, sf), "x", "y"),
        "relative_l2",
        "mse",
        "cosine",
    ).drop("x", "y", "label")


@query(
    "x17_reconstruction_summary",
    RECON + "SELECT label, count(*) AS n, round(avg(m), 8) AS mean, round(quantile_cont(m, 0.5), 8) AS median, round(stddev_pop(m), 8) AS sd, round(min(m), 8) AS min, round(max(m), 8) AS max, avg(m) <= 0.7 AS viable FROM (SELECT *, sqrt(er) / sqrt(xx) AS m FROM q) GROUP BY 1",
)
def x17_summary(spark, sf):
    return rounded(
        fx.reconstruction_summary(fx.reconstruction_metrics(recon(spark, sf), "x", "y"), ["label"], 0.7),
        "mean",
        "median",
        "sd",
        "min",
        "max",
    )


NINE = ("mse", "relative_l2", "normalized_mse", "explained_variance", "featurewise_normalized_mse", "featurewise_explained_variance", "mean_l0")


@query(
    "x18_fidelity_global",
    RECON + """, t AS (SELECT label, x, er, list_sum(x) / 64 AS m, len(list_filter(x, lambda v: v > 0.1)) AS k FROM q),
w AS (SELECT label, count(*) AS n, sum(er) AS sse, sum(k) AS active, sum(list_sum(list_transform(x, lambda v: (v - m) * (v - m)))) AS tc FROM t GROUP BY 1),
d AS (SELECT label, sum(s2) AS squares, sum(s2 - s1 * s1 / n) AS centred FROM (SELECT label, dim, sum(a) AS s1, sum(a * a) AS s2, count(*) AS n FROM (SELECT label, unnest(x) AS a, unnest(range(64)) AS dim FROM e) GROUP BY ALL) GROUP BY 1)
SELECT label, n AS token_count, CAST(n * 64 AS BIGINT) AS element_count, round(sse / (n * 64), 8) AS mse, round(sqrt(sse / squares), 8) AS relative_l2, round(sse / tc, 8) AS normalized_mse, round(1 - sse / tc, 8) AS explained_variance, round(sse / centred, 8) AS featurewise_normalized_mse, round(1 - sse / centred, 8) AS featurewise_explained_variance, round(active / n, 8) AS mean_l0 FROM w JOIN d USING (label)""",
)
def x18(spark, sf):
    """Two halves are summed by themselves and merged."""
    df = recon(spark, sf).withColumn("f", F.transform("x", lambda v: F.when(v > 0.1, v).otherwise(0.0)))
    halves = [fx.fidelity_state(df.where(F.col("vec_id") % 2 == k), ["label"], "x", "y", "f") for k in (0, 1)]
    return rounded(fx.fidelity_metrics(fx.merge_fidelity(*halves, keys=["label"]), ["label"]), *NINE)
