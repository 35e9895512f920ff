"""Queries of curation: customers are repositories, orders commits, lineitems files, parts and suppliers classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlab.functions.text import classify_patch
from pairlab.operators import curate as cu
from pairlab.plans.text import patch_sql
from pairlab.registry import query, table


def commits(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("hash"),
        F.col("o_custkey").alias("repo"),
        F.col("o_orderpriority").alias("msg"),
    )


def fixes(spark, sf):
    return table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("hash"),
        F.col("l_partkey").alias("vuln_id"),
    )


def classes(spark, sf):
    return table(spark, sf, "part").where("p_size > 5").select(
        F.col("p_partkey").alias("vuln_id"),
        F.col("p_brand").alias("category"),
    )


def files(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("hash"),
        F.col("l_linestatus").alias("language"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("file_id"),
        "l_quantity",
        "l_suppkey",
    )


LINKED = """SELECT DISTINCT c.o_orderkey AS hash, c.o_custkey AS repo, c.o_orderpriority AS msg, f.l_partkey AS vuln_id, p.p_brand AS category, l.l_linestatus AS language FROM orders c
LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R') f ON f.l_orderkey = c.o_orderkey LEFT JOIN (SELECT * FROM part WHERE p_size > 5) p ON p.p_partkey = f.l_partkey LEFT JOIN lineitem l ON l.l_orderkey = c.o_orderkey"""


def linked(spark, sf):
    return cu.link_commits(commits(spark, sf), fixes(spark, sf), classes(spark, sf), files(spark, sf))


@query("j1_link_commits", LINKED)
def j1(spark, sf):
    return linked(spark, sf).select("hash", "repo", "msg", "vuln_id", "category", "language")


@query("j2_classify_with_registry", f"""WITH {patch_sql("SELECT o_orderkey AS k, CASE o_orderpriority WHEN '1-URGENT' THEN 'Fix buffer overflow' WHEN '2-HIGH' THEN 'Refactor tests' WHEN '3-MEDIUM' THEN 'Tidy' END AS msg, o_custkey % 3 > 0 AS linked FROM orders")}
SELECT k AS o_orderkey, CASE WHEN v.s_suppkey IS NOT NULL THEN 'security_patch' ELSE decision END AS decision, CASE WHEN v.s_suppkey IS NOT NULL THEN 'registry' ELSE 'heuristic' END AS decided_by
FROM d JOIN orders ON o_orderkey = k LEFT JOIN supplier v ON v.s_suppkey = o_custkey AND o_custkey % 3 > 0""")
def j2(spark, sf):
    told = F.when(F.col("o_orderpriority") == "1-URGENT", "Fix buffer overflow").when(
        F.col("o_orderpriority") == "2-HIGH",
        "Refactor tests",
    ).when(F.col("o_orderpriority") == "3-MEDIUM", "Tidy")
    orders = table(spark, sf, "orders").select(
        "o_orderkey",
        told.alias("msg"),
        F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey").cast("string")).alias("id"),
    )
    verified = table(spark, sf, "supplier").select(
        F.concat(F.lit(" "), F.col("s_suppkey").cast("string")).alias("id"),
    )
    out = cu.classify_with_registry(orders, "id", verified, classify_patch("msg", F.col("id").isNotNull()))
    return out.select("o_orderkey", "decision", "decided_by")


@query(
    "j3_build_candidate_pairs",
    f"WITH a AS (SELECT DISTINCT hash, vuln_id, category FROM ({LINKED}) WHERE msg = '1-URGENT' AND category IS NOT NULL) SELECT hash, l_linenumber || '' AS line, l_quantity, vuln_id, category FROM (SELECT l_orderkey AS hash, * FROM lineitem) JOIN a USING (hash)",
)
def j3(spark, sf):
    accepted = linked(spark, sf).where("msg = '1-URGENT' AND category IS NOT NULL").select(
        "hash",
        "vuln_id",
        "category",
    )
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("hash"),
        F.col("l_linenumber").cast("string").alias("line"),
        "l_quantity",
    )
    return cu.build_candidate_pairs(lines, accepted, "hash")


@query("j4_method_rows", """
SELECT e.event_id, l.l_orderkey AS hash, l.l_partkey AS vuln_id FROM events e JOIN (SELECT l_orderkey AS hash, l_linenumber AS file_id FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_linestatus FROM lineitem WHERE l_linestatus = 'O')) f ON e.event_id = f.hash * 10 + f.file_id
JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R') l ON l.l_orderkey = f.hash WHERE l.l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25)""")
def j4(spark, sf):
    methods = table(spark, sf, "events").select("event_id", F.col("event_id").alias("file_id"))
    own = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("file_id"),
        F.col("l_orderkey").alias("hash"),
        F.col("l_linestatus").alias("language"),
    ).distinct()
    seeds = table(spark, sf, "part").where("p_size > 25").select(F.col("p_partkey").alias("vuln_id"))
    return cu.method_rows(methods, own, fixes(spark, sf), seeds, ["O"]).select("event_id", "hash", "vuln_id")


@query("j6_lineage_check", """
WITH d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 'X' ELSE o_orderstatus END AS st, o_orderpriority AS pr, CASE WHEN o_orderkey % 70 = 0 THEN o_orderkey + 100000000 WHEN o_orderkey % 7 = 0 THEN o_orderkey END AS seed FROM orders)
SELECT o_orderkey, 'missing_source' AS problem FROM d WHERE o_orderkey % 90 = 1 UNION ALL SELECT o_orderkey, 'differs_o_orderstatus' FROM d WHERE o_orderkey % 90 <> 1 AND o_orderkey % 50 = 0 UNION ALL SELECT o_orderkey, 'missing_seed' FROM d WHERE seed IS NOT NULL AND seed NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 90 <> 1)""")
def j6(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    seed = F.when(F.col("o_orderkey") % 70 == 0, F.col("o_orderkey") + 100000000).when(
        F.col("o_orderkey") % 7 == 0,
        F.col("o_orderkey"),
    )
    derived = orders.withColumns(
        {"o_orderstatus": F.when(F.col("o_orderkey") % 50 == 0, "X").otherwise(F.col("o_orderstatus")), "seed": seed},
    )
    return cu.lineage_check(
        derived,
        orders.where("o_orderkey % 90 != 1"),
        "o_orderkey",
        ["o_orderstatus", "o_orderpriority"],
        "seed",
    )


@query(
    "j7_coverage_gaps",
    "SELECT o_orderkey AS k, 'missing' AS gap FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT DISTINCT l_orderkey, 'unexpected' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)",
)
def j7(spark, sf):
    return cu.coverage_gaps(
        table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")),
        table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")),
        ["k"],
    )


@query(
    "j8_cross_split_leakage",
    "WITH s AS (SELECT sha256(text) AS key, substr(md5('42|' || doc_id), 1, 1) < '8' AS split FROM documents) SELECT key, count(DISTINCT split) AS splits, count(*) AS rows FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1",
)
def j8(spark, sf):
    docs = table(spark, sf, "documents").withColumn(
        "split",
        F.substring(F.md5(F.concat(F.lit("42|"), F.col("doc_id").cast("string"))), 1, 1) < "8",
    )
    return cu.cross_split_leakage(docs, "split", F.sha2("text", 256))


@query(
    "j9_build_worklist",
    "SELECT c_mktsegment || ':' || s || ':' || c_custkey AS record_id, layer, s AS seed FROM customer JOIN (SELECT * FROM (VALUES ('BUILDING', 3), ('MACHINERY', 7)) v(g, layer)) ON g = c_mktsegment, (SELECT unnest([42, 43]) AS s)",
)
def j9(spark, sf):
    routes = spark.createDataFrame([("BUILDING", 3), ("MACHINERY", 7)], "c_mktsegment string, layer int")
    return cu.build_worklist(
        table(spark, sf, "customer"),
        routes,
        [42, 43],
        "c_mktsegment",
        "c_custkey",
    ).select("record_id", "layer", "seed")


@query(
    "j11_assign_arms",
    "SELECT vec_id, k AS category, CASE WHEN label = k THEN 'unsafe' ELSE 'safe' END AS arm FROM embeddings, (SELECT unnest(range(10)) AS k)",
)
def j11(spark, sf):
    vectors = table(spark, sf, "embeddings")
    labels = vectors.select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("category"), "label").select(
        "vec_id",
        F.col("category").cast("long").alias("category"),
        (F.col("label") == F.col("category")).alias("unsafe"),
    )
    return cu.assign_arms(vectors.select("vec_id"), labels, "vec_id")


@query("j12_attach_metadata", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j12(spark, sf):
    return cu.attach_metadata(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")[1]


@query("w1_first_by_key", "SELECT md5(text) AS key, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def w1(spark, sf):
    return cu.first_by_key(
        table(spark, sf, "documents").select(F.md5("text").alias("key"), "doc_id"),
        ["key"],
        [F.col("doc_id")],
    )


@query(
    "w2_top_k",
    "SELECT * FROM (SELECT o_orderpriority, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 20",
)
def w2(spark, sf):
    out = cu.top_k(table(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice", "o_orderkey", 20)
    return out.select("o_orderpriority", "o_orderkey", "o_totalprice", F.col("rank").cast("long").alias("rank"))


@query(
    "w6_head_per_group",
    "SELECT c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS r FROM customer) WHERE r <= 12",
)
def w6(spark, sf):
    return cu.head_per_group(
        table(spark, sf, "customer"),
        ["c_mktsegment"],
        "c_custkey",
        12,
    ).select("c_mktsegment", "c_custkey")


SHIFTS = """WITH s AS (SELECT * FROM (VALUES ('w1', 1.0, 0.0), ('w2', 0.5, 30.0), ('w3', 0.0, 1.0)) v(setting, a, b)),
r AS (SELECT setting, p_brand, p_partkey, row_number() OVER (PARTITION BY setting, p_brand ORDER BY a * p_retailprice + b * p_size DESC, p_partkey) AS rank FROM part, s),
m AS (SELECT r.*, z.rank AS reference_rank FROM r LEFT JOIN r z ON z.setting = 'w1' AND z.p_brand = r.p_brand AND z.p_partkey = r.p_partkey) """


def shifts(spark, sf):
    settings = F.explode(
        F.array(
            *(
                F.struct(F.lit(n).alias("setting"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, a, b in (
                    ("w1", 1.0, 0.0),
                    ("w2", 0.5, 30.0),
                    ("w3", 0.0, 1.0),
                )
            ),
        ),
    )
    parts = table(spark, sf, "part").select(
        "p_brand",
        "p_partkey",
        "p_retailprice",
        "p_size",
        settings.alias("s"),
    ).select("p_brand", "p_partkey", "s.setting", (F.col("s.a") * F.col("p_retailprice") + F.col("s.b") * F.col("p_size")).alias("score"))
    return cu.rank_shift(parts, "setting", "w1", ["p_brand"], "p_partkey", "score", 10)


@query("w7_rank_shift", SHIFTS + "SELECT setting, p_brand, p_partkey, rank, rank - reference_rank AS shift FROM m")
def w7(spark, sf):
    return shifts(spark, sf)[0].select(
        "setting",
        "p_brand",
        "p_partkey",
        F.col("rank").cast("long").alias("rank"),
        F.col("shift").cast("long").alias("shift"),
    )


@query(
    "w7_rank_overlap",
    SHIFTS + ", n AS (SELECT setting, p_brand, count(*) FILTER (rank <= 10) AS n, count(*) FILTER (rank <= 10 AND reference_rank <= 10) AS b FROM m GROUP BY ALL) SELECT setting, p_brand, b AS \"both\", b / (2 * n - b) AS jaccard FROM n",
)
def w7_overlap(spark, sf):
    return shifts(spark, sf)[1]


@query(
    "w10_union_pairs",
    "SELECT n_nationkey AS k, n_name AS name, n_regionkey AS parent FROM nation UNION ALL SELECT r_regionkey, r_name, NULL FROM region",
)
def w10(spark, sf):
    return cu.union_pairs(
        table(spark, sf, "nation").select(
            F.col("n_nationkey").alias("k"),
            F.col("n_name").alias("name"),
            F.col("n_regionkey").alias("parent"),
        ),
        table(spark, sf, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("k")),
    )


@query(
    "w11_compare_selections",
    "WITH u AS (SELECT p_brand, p_size > 20 AS a, p_retailprice > 1200 AS b FROM part), c AS (SELECT p_brand, count(*) FILTER (a AND b) AS common, count(*) FILTER (b AND NOT a) AS added, count(*) FILTER (a AND NOT b) AS removed FROM u GROUP BY 1) SELECT *, common / (common + added + removed) AS jaccard FROM c WHERE common + added + removed > 0",
)
def w11(spark, sf):
    parts = table(spark, sf, "part")
    return cu.compare_selections(
        parts.where("p_size > 20"),
        parts.where("p_retailprice > 1200"),
        ["p_partkey"],
        ["p_brand"],
    )
