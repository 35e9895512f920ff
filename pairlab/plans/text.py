"""Queries of the text functions and filters, over documents, conversations and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlab.functions import text as tx
from pairlab.registry import query, table

LANG = {"en": "C++", "fr": "JavaScript", "de": "Python"}
LANG_SQL = "CASE lower(trim(lang)) WHEN 'en' THEN 'C++' WHEN 'fr' THEN 'JavaScript' WHEN 'de' THEN 'Python' ELSE upper(substr(lower(trim(lang)), 1, 1)) || substr(lower(trim(lang)), 2) END"
LINES_SQL = "len(list_filter(string_split_regex(text, '\\r?\\n'), lambda x: regexp_matches(x, '\\S')))"
TOKENS = ["icense", "the ", "de ", "der "]


def docs(spark, sf):
    return table(spark, sf, "documents")


@query("p1_keep_categories", "SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src5', 'src9')")
def p1(spark, sf):
    return tx.keep_categories(docs(spark, sf), "source", ["src1", "src5", "src9"]).select("doc_id", "source")


@query("p2_normalize_language", f"SELECT doc_id, {LANG_SQL} AS language FROM documents")
def p2(spark, sf):
    return docs(spark, sf).select("doc_id", tx.normalize_language("lang", LANG).alias("language"))


@query("p3_standardize_pairs", """
SELECT o_orderkey, coalesce(o_orderstatus, 'raw') AS o_orderstatus, 'unknown' AS origin, o_orderstatus = 'P' AS is_augmented,
  CASE WHEN o_orderstatus = 'P' THEN CAST(o_custkey AS VARCHAR) ELSE CAST(o_orderkey AS VARCHAR) END AS seed_id FROM orders""")
def p3(spark, sf):
    df = table(spark, sf, "orders").select(
        "o_orderkey",
        "o_orderstatus",
        (F.col("o_orderstatus") == "P").alias("is_augmented"),
        F.col("o_custkey").cast("string").alias("seed_id"),
        F.col("o_orderkey").cast("string").alias("own"),
    )
    return tx.standardize_pairs(
        df,
        {"o_orderstatus": "raw", "origin": "unknown"},
        "own",
        "is_augmented",
        "seed_id",
    ).drop("own")


@query(
    "p4_drop_blank_pairs",
    "SELECT conv_id, turn FROM conversations WHERE regexp_matches(text, '\\S') AND regexp_matches(nullif(role, 'system'), '\\S')",
)
def p4(spark, sf):
    df = table(spark, sf, "conversations").withColumn("role", F.nullif("role", F.lit("system")))
    return tx.drop_blank_pairs(df, "text", "role").select("conv_id", "turn")


@query(
    "p5_min_nonblank_lines",
    f"SELECT doc_id, CAST({LINES_SQL} AS BIGINT) AS n_lines FROM documents WHERE {LINES_SQL} >= 5",
)
def p5(spark, sf):
    return tx.min_nonblank_lines(docs(spark, sf), ["text"], 5).select(
        "doc_id",
        tx.nonblank_lines("text").cast("long").alias("n_lines"),
    )


@query("p6_truncate_lines", """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS x FROM documents)
SELECT doc_id, md5(CASE WHEN len(x) > 8 THEN array_to_string(list_concat(x[:4], ['... [truncated] ...'], x[-4:]), chr(10)) ELSE text END) AS short_md5 FROM l""")
def p6(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(tx.truncate_lines("text", 8)).alias("short_md5"))


@query("p7_filter_funnel", f"""
SELECT CASE WHEN NOT regexp_matches(text, '\\S') THEN 'blank' WHEN {LINES_SQL} < 3 THEN 'few_lines' WHEN lang = 'es' THEN 'language' ELSE 'kept' END AS reason, count(*) AS n
FROM documents GROUP BY 1""")
def p7(spark, sf):
    return tx.filter_funnel(
        docs(spark, sf),
        [
            ("blank", ~tx.not_blank("text")),
            ("few_lines", tx.nonblank_lines("text") < 3),
            ("language", F.col("lang") == "es"),
        ],
    )[1]


@query("p8_tag_role", """
SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'derivation' WHEN o_orderpriority = '3-MEDIUM' THEN 'heldout' ELSE 'unassigned' END AS role FROM orders""")
def p8(spark, sf):
    orders = table(spark, sf, "orders")
    roles = orders.select(F.col("o_orderpriority").alias("category")).distinct().withColumn(
        "role",
        F.when(F.col("category").isin("1-URGENT", "2-HIGH"), "derivation").when(
            F.col("category") == "3-MEDIUM",
            "heldout",
        ),
    ).where("role IS NOT NULL")
    return tx.tag_role(orders, "o_orderpriority", roles).select("o_orderkey", "role")


@query("p9_emptiness", """
WITH t AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 7 = 1 THEN '  ' ELSE text END AS text FROM documents)
SELECT doc_id, CASE WHEN text = '' THEN 'empty' WHEN NOT regexp_matches(text, '\\S') THEN 'whitespace_only' ELSE 'non_empty' END AS status FROM t""")
def p9(spark, sf):
    made = F.when(F.col("doc_id") % 7 == 0, "").when(F.col("doc_id") % 7 == 1, "  ").otherwise(F.col("text"))
    return docs(spark, sf).select("doc_id", tx.emptiness(made).alias("status"))


@query("p10_failure_counts", """
WITH t AS (SELECT source, CASE doc_id % 7 WHEN 0 THEN 'HOOK_EXCEPTION' WHEN 1 THEN 'GENERATION_EXCEPTION' WHEN 2 THEN 'MALFORMED_GENERATION' WHEN 3 THEN 'WHITESPACE_ONLY' WHEN 4 THEN 'odd' WHEN 5 THEN 'SUCCESS' END AS s, CASE WHEN doc_id % 10 < 8 THEN 'NONE' WHEN doc_id % 10 = 8 THEN 'USED' END AS f FROM documents)
SELECT source, count(*) AS n, count(*) FILTER (s = 'HOOK_EXCEPTION') AS n_hook, count(*) FILTER (s = 'GENERATION_EXCEPTION') AS n_generation, count(*) FILTER (s = 'MALFORMED_GENERATION') AS n_malformed,
  count(*) FILTER (s IS NULL OR s = 'odd') AS n_other, count(*) FILTER (f IS DISTINCT FROM 'NONE') AS n_fallback FROM t GROUP BY source""")
def p10(spark, sf):
    i, j = F.col("doc_id") % 7, F.col("doc_id") % 10
    names = ["HOOK_EXCEPTION", "GENERATION_EXCEPTION", "MALFORMED_GENERATION", "WHITESPACE_ONLY", "odd", "SUCCESS"]
    status = F.get(F.array(*(F.lit(x) for x in names)), i.cast("int"))
    return tx.failure_counts(docs(spark, sf), ["source"], status, F.when(j < 8, "NONE").when(j == 8, "USED"))


@query("p11_looks_like_code", """
WITH t AS (SELECT doc_id, text, CASE WHEN contains(text, 'icense') THEN 'icense' WHEN contains(text, 'the ') THEN 'the ' WHEN contains(text, 'de ') THEN 'de ' WHEN contains(text, 'der ') THEN 'der ' END AS marker FROM documents)
SELECT doc_id, length(trim(text)) >= 10 AND marker IS NOT NULL AS ok, CASE WHEN length(trim(text)) < 10 THEN 'too_short' WHEN marker IS NULL THEN 'no_code_token' END AS reason, marker FROM t""")
def p11(spark, sf):
    ok, reason, marker = tx.looks_like_code("text", TOKENS)
    return docs(spark, sf).select("doc_id", ok.alias("ok"), reason.alias("reason"), marker.alias("marker"))


@query(
    "p12_scan_eligible",
    "SELECT doc_id, lang IN ('en', 'fr') AND regexp_matches(text, '\\S') AS eligible FROM documents",
)
def p12(spark, sf):
    return docs(spark, sf).select("doc_id", tx.scan_eligible("lang", "text", ["en", "fr"]).alias("eligible"))


@query(
    "p13_eligible_population",
    "SELECT lang, source, count(*) AS n FROM documents WHERE NOT (lang IN ('en', 'de') AND source IN ('src1', 'src2')) GROUP BY ALL",
)
def p13(spark, sf):
    d = docs(spark, sf)
    allowed = d.where("lang IN ('en', 'de') AND source IN ('src1', 'src2')").select("lang", "source").distinct()
    return tx.eligible_population(d, allowed, ["lang", "source"])[1]


@query(
    "p14_export_metadata",
    "SELECT conv_id, turn AS source_order, sha256(role) AS role_sha256, sha256(text) AS text_sha256, sha256(sha256(role) || ':' || sha256(text)) AS pair_sha256 FROM conversations",
)
def p14(spark, sf):
    return tx.export_metadata(
        table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"),
        ["role", "text"],
        "turn",
    )


def hits_sql(words: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains(x, '{w}') AS INT)" for w in words) + ")"


def patch_sql(source: str) -> str:
    """CTE d (k, x, linked, decision) from a query of (k, msg, linked)."""
    return f"""t AS (SELECT k, lower(msg) AS x, linked FROM ({source})), h AS (SELECT *, {hits_sql(tx.SECURITY_WORDS)} AS s, {hits_sql(tx.OTHER_WORDS)} AS o FROM t),
d AS (SELECT *, CASE WHEN coalesce(x, '') = '' THEN CASE WHEN linked THEN 'security_patch' ELSE 'undecidable' END WHEN regexp_matches(x, 'cve-\\d{{4}}-\\d+') OR (linked AND s > 0) THEN 'security_patch' WHEN linked AND o > 0 THEN 'undecidable'
  WHEN NOT linked AND o > 0 AND s = 0 THEN 'non_security_patch' WHEN s > o THEN 'security_patch' WHEN o > s THEN 'non_security_patch' ELSE 'undecidable' END AS decision FROM h)"""


@query(
    "f1_classify_patch",
    f"WITH {patch_sql("SELECT doc_id AS k, CASE WHEN doc_id % 11 > 0 THEN text END AS msg, source = 'src1' AS linked FROM documents")} SELECT k AS doc_id, decision FROM d",
)
def f1(spark, sf):
    msg = F.when(F.col("doc_id") % 11 > 0, F.col("text"))
    return docs(spark, sf).select("doc_id", tx.classify_patch(msg, F.col("source") == "src1").alias("decision"))


@query(
    "f2_hunk_id",
    "SELECT doc_id, md5(concat_ws('|', source, lang, substr(text, 1, 200))) AS hunk_id FROM documents",
)
def f2(spark, sf):
    return docs(spark, sf).select(
        "doc_id",
        tx.hunk_id(F.col("source"), F.col("lang"), F.col("text")).alias("hunk_id"),
    )


@query("f3_pair_digest", "SELECT page_id, sha256(sha256(url) || ':' || sha256(html)) AS digest FROM pages")
def f3(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.pair_digest("url", "html").alias("digest"))


@query("f4_ordered_digest", """
WITH b AS (SELECT o_orderpriority, o_custkey // 1000 AS b, count(*) AS n, sha256(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_custkey, o_orderkey)) AS d FROM orders GROUP BY ALL)
SELECT o_orderpriority, CAST(sum(n) AS BIGINT) AS n_ids, sha256(string_agg(d, ',' ORDER BY b)) AS digest FROM b GROUP BY 1""")
def f4(spark, sf):
    return tx.ordered_digest(table(spark, sf, "orders"), ["o_orderpriority"], "o_orderkey", "o_custkey")


@query(
    "f4_canonical_digest",
    "SELECT o_orderpriority, count(*) AS n_ids, sha256('[' || string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_custkey, o_orderkey) || ']') AS digest FROM orders GROUP BY 1",
)
def f4_canonical(spark, sf):
    return tx.canonical_digest(table(spark, sf, "orders"), ["o_orderpriority"], "o_orderkey", "o_custkey")


@query("f5_augment_by_substitution", """
WITH s AS (SELECT * FROM (VALUES ('en', 'the ', 'a safe '), ('en', 'of ', 'from '), ('de', 'der ', 'die ')) v(l, i, c)),
h AS (SELECT * FROM documents JOIN s ON lang = l),
u AS (SELECT CAST(doc_id AS VARCHAR) AS seed_id, lang AS language, text AS v, replace(text, i, c) AS f FROM h WHERE contains(text, i) UNION ALL SELECT CAST(doc_id AS VARCHAR), lang, replace(text, c, i), text FROM h WHERE contains(text, c))
SELECT DISTINCT seed_id, language, md5(concat_ws('|', seed_id, md5(v), md5(f))) AS pair_id FROM u""")
def f5(spark, sf):
    subs = spark.createDataFrame(
        [("en", "the ", "a safe "), ("en", "of ", "from "), ("de", "der ", "die ")],
        "language string, insecure string, secure string",
    )
    return tx.augment_by_substitution(docs(spark, sf), subs, "lang", "text", "doc_id").select(
        "seed_id",
        "language",
        "pair_id",
    )


FENCED = "CASE doc_id % 3 WHEN 0 THEN 'say' || chr(10) || '```py' || chr(10) || text || chr(10) || '```' || chr(10) || 'end' WHEN 1 THEN 'Assistant:' || chr(10) || text ELSE text END"
BLOCK = r"(?s)```[^\r\n]*\r?\n(.*?)(?:\r?\n```|```)"


def fenced_docs(spark, sf):
    kind, text = F.col("doc_id") % 3, F.col("text")
    made = F.when(kind == 0, F.concat(F.lit("say\n```py\n"), text, F.lit("\n```\nend"))).when(
        kind == 1,
        F.concat(F.lit("Assistant:\n"), text),
    ).otherwise(text)
    return docs(spark, sf).select("doc_id", "source", made.alias("reply"))


@query("f7_extract_fenced", f"""
WITH t AS (SELECT doc_id, text, {FENCED} AS reply FROM documents)
SELECT doc_id, md5(CASE WHEN regexp_matches(reply, '{BLOCK}') THEN regexp_extract(reply, '{BLOCK}', 1) ELSE reply END) AS first_md5, md5(CASE WHEN doc_id % 3 = 0 THEN text ELSE reply END) AS all_md5 FROM t""")
def f7(spark, sf):
    return fenced_docs(spark, sf).select(
        "doc_id",
        F.md5(tx.extract_fenced("reply")).alias("first_md5"),
        F.md5(tx.extract_fenced("reply", "all")).alias("all_md5"),
    )


@query("f8_content_audit", f"""
WITH t AS (SELECT source, {FENCED} AS c FROM documents), g AS (SELECT source, c, coalesce(list_filter(string_split_regex(c, '\\r?\\n'), lambda x: regexp_matches(x, '\\S'))[1], '') AS l FROM t)
SELECT source, count(*) AS n, count(*) FILTER (contains(c, '```')) AS n_has_fence, count(*) FILTER (contains(c, '<|') OR regexp_matches(c, '(?im)^\\s*(?:<\\|)?(?:assistant|system|user)(?:\\|>)?\\s*:?\\s*$')) AS n_has_role_marker,
  count(*) FILTER (NOT regexp_matches(c, '\\S')) AS n_is_blank, count(*) FILTER (starts_with(l, 'The') OR starts_with(l, 'say')) AS n_starts_with_token, count(*) FILTER (regexp_matches(c, '{BLOCK}')) AS n_changed_by_extraction FROM g GROUP BY source""")
def f8(spark, sf):
    return tx.content_audit(fenced_docs(spark, sf), ["source"], "reply", ["The", "say"])


@query(
    "f9_choice_letter",
    "SELECT conv_id, turn, coalesce(nullif(regexp_extract(upper(text), '[ABCD]'), ''), 'X') AS choice FROM conversations",
)
def f9(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.choice_letter("text").alias("choice"))


@query("f10_py_syntax_ok")
def f10(spark, sf):
    made = F.when(
        F.col("doc_id") % 2 == 0,
        F.concat(F.lit("x = "), F.col("doc_id").cast("string")),
    ).otherwise(F.col("text"))
    return docs(spark, sf).select("doc_id", tx.py_syntax_ok(tx.extract_fenced(made)).alias("ok"))


@query("f11_line_diff")
def f11(spark, sf):
    d = docs(spark, sf).withColumn("other", F.replace("text", F.lit("the "), F.lit("a ")))
    removed, added = tx.changed_line_counts("text", "other")
    return d.select(
        "doc_id",
        tx.line_diff("text", "other").alias("diff"),
        removed.cast("long").alias("n_removed"),
        added.cast("long").alias("n_added"),
    )


@query(
    "f12_rate_text",
    "SELECT l_orderkey, printf('%.6f', avg(l_discount)) AS rate, round_even(avg(l_quantity), 1) AS half_even FROM lineitem GROUP BY l_orderkey",
)
def f12(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        tx.rate_text(F.avg("l_discount")).alias("rate"),
        F.bround(F.avg("l_quantity"), 1).alias("half_even"),
    )


@query("f13_secret_scan", """
WITH p AS (SELECT * FROM (VALUES ('mail', '@[a-z0-9]+\\.example\\.com'), ('address', '\\b\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\b'), ('license', '[Ll]icense')) v(name, pattern))
SELECT doc_id, name FROM documents, p WHERE regexp_matches(text, pattern)""")
def f13(spark, sf):
    patterns = [
        ("mail", r"@[a-z0-9]+\.example\.com"),
        ("address", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"),
        ("license", "[Ll]icense"),
    ]
    return tx.secret_scan(docs(spark, sf), "doc_id", "text", patterns)
