"""Queries of the scanning operators over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlab.operators import scan
from pairlab.registry import query, table
from pairlab.sources import io
from pairlab.streaming.scan_stream import scan_stream

RULES = [
    ("license", "license-short", r"CC BY"),
    ("license", "license-any", r"[Ll]icense"),
    ("mail", "mail-own", r"@mail\d\.example\.com"),
    ("mail", "mail-any", r"@[a-z0-9]+\.example"),
    ("address", "ip", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"),
    ("symbols", "pipes", r"\|"),
    ("words", "tion", r"tion\b"),
]
TAXONOMY = ["license", "mail", "address", "symbols", "words", "unused"]
#: The same as scan_rules, as a table of (doc_id, category, rule_id).
HITS = """hits AS (
  SELECT doc_id, 'license' AS category, CASE WHEN regexp_matches(text, 'CC BY') THEN 'license-short' ELSE 'license-any' END AS rule_id FROM documents WHERE regexp_matches(text, 'CC BY|[Ll]icense')
  UNION ALL SELECT doc_id, 'mail', CASE WHEN regexp_matches(text, '@mail\\d\\.example\\.com') THEN 'mail-own' ELSE 'mail-any' END FROM documents WHERE regexp_matches(text, '@mail\\d\\.example\\.com|@[a-z0-9]+\\.example')
  UNION ALL SELECT doc_id, 'address', 'ip' FROM documents WHERE regexp_matches(text, '\\b\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\b')
  UNION ALL SELECT doc_id, 'symbols', 'pipes' FROM documents WHERE regexp_matches(text, '\\|')
  UNION ALL SELECT doc_id, 'words', 'tion' FROM documents WHERE regexp_matches(text, 'tion\\b'))"""
FLAGS = f"""WITH {HITS}, flags AS (
  SELECT d.doc_id, d.source, d.lang, coalesce(list_sort(list(category) FILTER (category IS NOT NULL)), []) AS detected, count(category) AS n_findings,
    coalesce(bool_or(category IN ('license', 'mail', 'address')), false) AS is_vulnerable FROM documents d LEFT JOIN hits USING (doc_id) GROUP BY ALL)"""


def scanned(spark, sf):
    """Documents with findings and flags; the target category goes by source."""
    docs = table(spark, sf, "documents").select(
        "doc_id",
        "source",
        "lang",
        scan.scan_rules("text", RULES).alias("findings"),
    )
    target = F.when(F.col("source") == "src1", "mail").otherwise("license")
    return scan.derive_flags(docs.withColumn("target", target), "findings", ["license", "mail", "address"], "target")


@query("d1_scan_rules", f"WITH {HITS} SELECT doc_id, category, rule_id FROM hits")
def d1(spark, sf):
    return scanned(spark, sf).select("doc_id", F.explode("findings").alias("f")).select(
        "doc_id",
        "f.category",
        "f.rule_id",
    )


@query("d1_scan_rule_table", f"WITH {HITS} SELECT doc_id, category, rule_id FROM hits")
def d1_table(spark, sf):
    rules = spark.createDataFrame(
        [(c, i, r, p) for i, (c, r, p) in enumerate(RULES)],
        "category string, rule_order int, rule_id string, pattern string",
    )
    return scan.scan_rule_table(table(spark, sf, "documents"), "doc_id", "text", rules)


#: As many rules as need an index of their literals.
MANY = [(f"c{i % 10}", f"mail-{i}-{k}", rf"@mail{i}\.example\.{k}") for i in range(40) for k in ("com", "org", "net", "info", "edu")]


@query("d1_many_rules", f"""WITH r AS (SELECT 'c' || i % 10 AS category, 'mail-' || i || '-' || k AS rule_id, '@mail' || i || '\\.example\\.' || k AS pattern, i * 5 + p AS o FROM (SELECT unnest(range(40)) AS i), (SELECT unnest(['com', 'org', 'net', 'info', 'edu']) AS k, unnest(range(5)) AS p)),
d AS (SELECT doc_id, text FROM documents WHERE contains(text, '@mail'))
SELECT doc_id, category, arg_min(rule_id, o) AS rule_id FROM d, r WHERE regexp_matches(text, pattern) GROUP BY ALL""")
def d1_many(spark, sf):
    rules = spark.createDataFrame([(c, i, r, p) for i, (c, r, p) in enumerate(MANY)], "category string, rule_order int, rule_id string, pattern string")
    return scan.scan_rule_table(table(spark, sf, "documents"), "doc_id", "text", rules)


@query("d2_map_rules", """
WITH m AS (SELECT * FROM (VALUES ('BRASS', 'metal', 2), ('STEEL', 'metal', 1), ('ECONOMY', 'cheap', 3), ('PROMO', 'cheap', 0)) v(r, c, o)),
t AS (SELECT DISTINCT p_type FROM part), b AS (SELECT p_type, arg_min(c, (CASE WHEN p_type = r THEN 0 ELSE 100 END) + o) AS category FROM t JOIN m ON contains(p_type, r) GROUP BY 1)
SELECT p_partkey, p_type AS rule_id, category FROM part LEFT JOIN b USING (p_type)""")
def d2(spark, sf):
    mapping = spark.createDataFrame(
        [("BRASS", "metal", 2), ("STEEL", "metal", 1), ("ECONOMY", "cheap", 3), ("PROMO", "cheap", 0)],
        "rule_id string, category string, order int",
    )
    return scan.map_rules(
        table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("rule_id")),
        mapping,
    ).select("p_partkey", "rule_id", "category")


@query(
    "d3_merge_findings",
    f"WITH {HITS} SELECT doc_id, count(DISTINCT (category, rule_id)) AS n FROM (SELECT * FROM hits UNION ALL SELECT doc_id, category, rule_id FROM hits WHERE category = 'mail' UNION ALL SELECT doc_id, 'license', 'license-any' FROM documents WHERE regexp_matches(text, '[Ll]icense')) GROUP BY 1",
)
def d3(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id",
        scan.scan_rules("text", RULES).alias("a"),
        scan.scan_rules("text", [RULES[2], RULES[3], RULES[1]]).alias("b"),
    )
    return docs.select(
        "doc_id",
        F.size(scan.merge_findings(F.col("a"), F.col("b"))).cast("long").alias("n"),
    ).where("n > 0")


@query(
    "d4_derive_flags",
    FLAGS + " SELECT doc_id, array_to_string(detected, ',') AS detected, is_vulnerable, list_contains(detected, CASE WHEN source = 'src1' THEN 'mail' ELSE 'license' END) AS target_present, n_findings > 0 AS any_finding FROM flags",
)
def d4(spark, sf):
    return scanned(spark, sf).select(
        "doc_id",
        F.array_join("detected", ",").alias("detected"),
        "is_vulnerable",
        "target_present",
        "any_finding",
    )


@query(
    "d5_scan_incremental",
    f"WITH {HITS} SELECT doc_id, count(rule_id) AS n FROM documents LEFT JOIN hits USING (doc_id) WHERE doc_id % 3 <> 0 GROUP BY 1",
)
def d5(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    done = docs.where("doc_id % 3 = 0").select(
        "doc_id",
        scan.rules_fingerprint(RULES).alias("rules_hash"),
    ).unionByName(docs.select("doc_id", F.lit("older rules").alias("rules_hash")))
    return scan.scan_incremental(docs, done, "doc_id", "text", RULES).select(
        "doc_id",
        F.size("findings").cast("long").alias("n"),
    )


@query(
    "d6_prevalence",
    FLAGS + " SELECT source, count(*) AS total, count(*) FILTER (is_vulnerable) AS vulnerable, count(*) FILTER (is_vulnerable) / count(*) AS rate, CAST(sum(n_findings) AS DOUBLE) / count(*) AS findings_per_record FROM flags GROUP BY source",
)
def d6(spark, sf):
    return scan.prevalence(scanned(spark, sf), ["source"])


@query(
    "d7_category_distribution",
    f"WITH {HITS} SELECT category, count(DISTINCT doc_id) AS records, count(doc_id) AS findings FROM (SELECT unnest(['license', 'mail', 'address', 'symbols', 'words', 'unused']) AS category) LEFT JOIN hits USING (category) GROUP BY 1",
)
def d7(spark, sf):
    taxonomy = spark.createDataFrame([(c,) for c in TAXONOMY], "category string")
    return scan.category_distribution(scanned(spark, sf), "doc_id", taxonomy)


@query(
    "d8_co_occurrence",
    f"WITH {HITS} SELECT x.category AS a, y.category AS b, count(*) AS n FROM hits x JOIN hits y ON x.doc_id = y.doc_id AND x.category < y.category GROUP BY ALL",
)
def d8(spark, sf):
    return scan.co_occurrence(scanned(spark, sf))


@query(
    "d9_partition_ids",
    FLAGS + ", c AS (SELECT unnest([NULL, 'license', 'mail', 'address', 'symbols', 'words', 'unused']) AS category) SELECT category, doc_id, CASE WHEN category IS NULL THEN n_findings > 0 ELSE list_contains(detected, category) END AS unsafe FROM flags, c",
)
def d9(spark, sf):
    return scan.partition_ids(scanned(spark, sf), "doc_id", TAXONOMY)


@query("d10_audit_sample", FLAGS + """, h AS (SELECT doc_id, detected, is_vulnerable, CASE WHEN source < 'src3' THEN 'license' WHEN source < 'src6' THEN 'mail' ELSE 'words' END AS category, md5('42|' || doc_id) AS h FROM flags),
a AS (SELECT doc_id, 'mail' AS target, 'detected' AS picked_as FROM (SELECT * FROM h WHERE list_contains(detected, 'mail') ORDER BY h LIMIT 5) UNION ALL SELECT doc_id, 'mail', 'not_detected' FROM (SELECT * FROM h WHERE category = 'mail' AND NOT list_contains(detected, 'mail') ORDER BY h LIMIT 3)),
r AS (SELECT * FROM h WHERE doc_id NOT IN (SELECT doc_id FROM a)),
b AS (SELECT doc_id, 'license' AS target, 'detected' AS picked_as FROM (SELECT * FROM r WHERE list_contains(detected, 'license') ORDER BY h LIMIT 8) UNION ALL SELECT doc_id, 'license', 'not_detected' FROM (SELECT * FROM r WHERE category = 'license' AND NOT list_contains(detected, 'license') ORDER BY h LIMIT 3)),
p AS (SELECT * FROM a UNION ALL SELECT * FROM b),
q AS (SELECT doc_id, row_number() OVER (ORDER BY h, doc_id) AS n FROM h WHERE NOT is_vulnerable AND doc_id NOT IN (SELECT doc_id FROM p))
SELECT * FROM p UNION ALL SELECT doc_id, 'none', 'padding' FROM q WHERE n <= 30 - (SELECT count(*) FROM p)""")
def d10(spark, sf):
    category = F.when(F.col("source") < "src3", "license").when(F.col("source") < "src6", "mail").otherwise("words")
    return scan.audit_sample(
        scanned(spark, sf).withColumn("category", category),
        "doc_id",
        "category",
        {"mail": 5, "license": 8},
        3,
        30,
        42,
    )


@query("d11_confusion", FLAGS + """, j AS (SELECT source, list_contains(detected, 'symbols') AS p, quality = 0 AS t FROM flags JOIN labels USING (doc_id))
SELECT source, count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (NOT p AND t) AS fn, count(*) FILTER (NOT p AND NOT t) AS tn,
  count(*) FILTER (p AND NOT t) / nullif(count(*) FILTER (NOT t), 0) AS fpr FROM j GROUP BY ROLLUP (source)""")
def d11(spark, sf):
    joined = scanned(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    return scan.confusion(joined, F.array_contains("detected", "symbols"), F.col("quality") == 0, ["source"])


@query(
    "t1_scan_stream",
    f"WITH {HITS} SELECT doc_id, count(rule_id) AS n FROM documents LEFT JOIN hits USING (doc_id) GROUP BY 1",
)
def t1(spark, sf):
    """The stream reads a copy of documents, as a file source wants a folder, and is started twice."""
    base = io.scratch(spark, "t1")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    docs.where("doc_id % 2 = 0").write.mode("append").parquet(f"{base}/in")
    run = lambda: scan_stream(spark, f"{base}/in", "doc_id long, text string", f"{base}/out", f"{base}/state", "doc_id", "text", RULES).awaitTermination()
    run()
    docs.where("doc_id % 2 = 1 OR doc_id % 10 = 0").write.mode("append").parquet(f"{base}/in")
    run()
    return spark.read.parquet(f"{base}/out").select("doc_id", F.size("findings").cast("long").alias("n"))
