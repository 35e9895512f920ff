"""Queries of the record checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlab.operators import quality as qa
from pairlab.operators import sampling as sm
from pairlab.registry import query, table


@query(
    "i1_duplicates",
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def i1(spark, sf):
    return qa.duplicates(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("i2_check_chain", """
WITH p AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS x FROM orders), q AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 40 = 0 THEN '?' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 90 <> 0), r AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice > 300000 OR o_orderkey % 500 = 3 AS flag FROM orders),
j AS (SELECT p.k, p.s, q.s AS qs, r.s AS rs, x, flag FROM p LEFT JOIN q USING (k) LEFT JOIN r USING (k))
SELECT k, 'output_s' AS rule FROM j WHERE s IS DISTINCT FROM qs UNION ALL SELECT k, 'scan_s' FROM j WHERE s IS DISTINCT FROM rs UNION ALL SELECT k, 'flag' FROM j WHERE flag <> (x > 300000)""")
def i2(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"),
        F.col("o_orderstatus").alias("s"),
        F.col("o_totalprice").alias("x"),
    )
    outputs = orders.where("k % 90 != 0").select(
        "k",
        F.when(F.col("k") % 40 == 0, "?").otherwise(F.col("s")).alias("s"),
    )
    scans = orders.select("k", "s", F.expr("x > 300000 OR k % 500 = 3").alias("flag"))
    return qa.check_chain(
        orders,
        outputs,
        scans,
        "k",
        ["s"],
        {"flag": F.col("scan_flag") == (F.col("prompt_x") > 300000)},
    )


@query("i3_split_report", """
WITH s AS (SELECT o_orderpriority AS c, o_custkey AS u, o_orderstatus = 'P' AS a, o_totalprice > 1000 AS sec, CASE WHEN o_orderpriority = '5-LOW' AND o_orderkey % 100 <> 0 THEN 'test' WHEN md5('42|' || o_custkey) < '9' THEN 'train' ELSE 'test' END AS split FROM orders),
m AS (SELECT * FROM (VALUES ('1-URGENT', 20), ('2-HIGH', 1000000), ('3-MEDIUM', 50), ('0-ABSENT', 1)) v(c, least)),
z AS (SELECT c, count(*) AS n, avg(CAST(a AS INT)) AS aug, avg(CAST(sec AS INT)) AS sec FROM s GROUP BY 1),
d AS (SELECT m.c, least, coalesce(n, 0) AS n FROM m LEFT JOIN z USING (c))
SELECT 'unit_overlap' AS "check", NULL AS category, CASE WHEN x = 0 THEN 'PASS' ELSE 'FAIL' END AS status, CAST(x AS DOUBLE) AS observed, CAST(0 AS DOUBLE) AS "limit" FROM (SELECT count(*) AS x FROM (SELECT u FROM s WHERE c <> '5-LOW' OR split <> 'test' GROUP BY u HAVING count(DISTINCT split) > 1))
UNION ALL SELECT 'heldout_outside_test', NULL, CASE WHEN x = 0 THEN 'PASS' ELSE 'FAIL' END, x, 0 FROM (SELECT count(*) AS x FROM s WHERE c = '5-LOW' AND split <> 'test')
UNION ALL SELECT 'category_ratio', NULL, CASE WHEN x > 3 THEN 'FAIL' ELSE 'PASS' END, x, 3 FROM (SELECT max(n) / min(n) AS x FROM d WHERE n > 0)
UNION ALL SELECT 'total', NULL, CASE WHEN count(*) < 500 THEN 'FAIL' ELSE 'PASS' END, count(*), 500 FROM s
UNION ALL SELECT 'category_minimum', c, CASE WHEN n < least THEN 'FAIL' ELSE 'PASS' END, n, least FROM d
UNION ALL SELECT 'augmented_fraction', c, CASE WHEN aug > 0.025 THEN 'FAIL' ELSE 'PASS' END, aug, 0.025 FROM z
UNION ALL SELECT 'secure_fraction', c, CASE WHEN sec < 1 THEN 'WARN' ELSE 'PASS' END, sec, 1 FROM z""")
def i3(spark, sf):
    held = (F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderkey") % 100 != 0)
    df = table(spark, sf, "orders").withColumn(
        "split",
        F.when(held, "test").when(sm.hash_order(42, "o_custkey") < "9", "train").otherwise("test"),
    )
    return qa.split_report(
        df,
        "split",
        "o_custkey",
        "o_orderpriority",
        ["5-LOW"],
        {"1-URGENT": 20, "2-HIGH": 1_000_000, "3-MEDIUM": 50, "0-ABSENT": 1},
        augmented=F.col("o_orderstatus") == "P",
        most_augmented=0.025,
        secure=F.col("o_totalprice") > 1000,
    )


@query(
    "i4_set_checks",
    "SELECT 'disjoint' AS \"check\", 'open' AS a, 'done' AS b, CAST(0 AS BIGINT) AS violations UNION ALL SELECT 'disjoint', 'open', 'large', (SELECT count(*) FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 400000) UNION ALL SELECT 'nested', 'large', 'open', (SELECT count(*) FROM orders WHERE o_orderstatus <> 'O' AND o_totalprice > 400000)",
)
def i4(spark, sf):
    orders = table(spark, sf, "orders")
    sets = {
        "open": orders.where("o_orderstatus = 'O'"),
        "done": orders.where("o_orderstatus = 'F'"),
        "large": orders.where("o_totalprice > 400000"),
    }
    return qa.set_checks(sets, "o_orderkey", [("open", "done"), ("open", "large")], [("large", "open")])


@query(
    "i5_drift",
    "SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'new' WHEN doc_id % 13 = 0 THEN 'changed' END AS state FROM documents WHERE doc_id % 11 = 0 OR doc_id % 13 = 0 UNION ALL SELECT doc_id + 100000000, 'missing' FROM documents WHERE doc_id % 17 = 0",
)
def i5(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    manifest = docs.where("doc_id % 11 != 0").select(
        "doc_id",
        F.sha2(F.when(F.col("doc_id") % 13 == 0, "old").otherwise(F.col("text")), 256).alias("sha256"),
    ).unionByName(docs.where("doc_id % 17 = 0").select(F.col("doc_id") + 100000000, F.sha2("text", 256)).toDF("doc_id", "sha256"))
    return qa.drift(docs, manifest, "doc_id", F.col("text"))


@query(
    "i6_metric_drift",
    "WITH m AS (SELECT l_suppkey, round(avg(l_quantity), 6) AS v FROM lineitem GROUP BY 1) SELECT l_suppkey, v + CASE WHEN l_suppkey % 9 = 0 THEN 0.5 ELSE 0 END AS reported, CASE WHEN l_suppkey % 10 = 0 THEN NULL ELSE v END AS recomputed FROM m WHERE l_suppkey % 9 = 0 OR l_suppkey % 10 = 0",
)
def i6(spark, sf):
    means = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg("l_quantity"), 6).alias("v"))
    reported = means.withColumn("v", F.col("v") + F.when(F.col("l_suppkey") % 9 == 0, 0.5).otherwise(0.0))
    return qa.metric_drift(reported, means.where("l_suppkey % 10 != 0"), ["l_suppkey"], "v", 0.001)


@query(
    "i7_forbidden_fields",
    "SELECT doc_id, 'source' AS field FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'lang' FROM documents WHERE lang <> 'en'",
)
def i7(spark, sf):
    df = table(spark, sf, "documents").select(
        "doc_id",
        F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(" ").alias("source"),
        F.nullif("lang", F.lit("en")).alias("lang"),
    )
    return qa.forbidden_fields(df, ["doc_id"], ["source", "lang", "absent"])
