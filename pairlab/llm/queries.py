"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairlab.llm import bpe, chat, fingerprints, line_dedup, minhash, neighbours, packing, quality, runs, suffix, token_store, url_filter, whitening
from pairlab.llm.common import table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = bpe.decode_documents(bpe.encode_documents(docs, BYTE_BPE), BYTE_BPE)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


#: The rules of op2: hosts and paths, and what becomes of them.
URL_RULES = [
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every url by rules, and by the links between hosts where none fits."""
    judged = url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def _url_parts(url: str) -> str:
    rest = f"CASE WHEN contains({url}, '://') THEN substr({url}, instr({url}, '://') + 3) ELSE '' END"
    host = f"translate(regexp_extract({rest}, '^[^/?#]*'), '{url_filter.UPPER}', '{url_filter.LOWER}')"
    return f"{host} AS host, regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) AS path"


#: Walks of 160 links: what is left then is below 1e-11 of a seed's share.
OP2_SQL = rf"""
WITH RECURSIVE rules AS (SELECT * FROM (VALUES {", ".join(map(str, URL_RULES))}) v(rule, verdict)),
h AS (SELECT page_id, html, {_url_parts("url")} FROM pages),
f AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM h JOIN rules ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, instr(rule, '/'))) GROUP BY 1),
j AS (SELECT page_id, host, path, rule, verdict FROM h LEFT JOIN f USING (page_id)),
c AS (SELECT host, count(*) FILTER (verdict = 'allow') AS a, count(*) FILTER (verdict = 'block') AS b FROM j WHERE rule IS NOT NULL GROUP BY 1),
targets AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)<a\s[^<>]*?href\s*=\s*["'']?([^"''\s<>]+)', 1)) AS t FROM h WHERE host <> ''),
parsed AS (SELECT src, {_url_parts("CASE WHEN starts_with(t, '//') THEN 'x:' || t ELSE t END")} FROM targets WHERE contains(t, '//')),
named AS (SELECT string_split(host, '.') AS p, count(*) AS n FROM h WHERE host <> '' GROUP BY 1),
up AS (SELECT array_to_string(p[i:], '.') AS src, array_to_string(p[i + 1:], '.') AS dst, n FROM named, unnest(range(1, len(p) - 1)) r(i) WHERE len(p) > 2),
links AS (SELECT src, dst, sum(n) AS n FROM (SELECT src, host AS dst, 1 AS n FROM parsed WHERE host <> '' AND host <> src UNION ALL SELECT * FROM up WHERE src <> '' AND dst <> '' UNION ALL SELECT dst, src, n FROM up WHERE src <> '' AND dst <> '') GROUP BY 1, 2),
steps AS (SELECT 'trust' AS kind, src, dst, n / sum(n) OVER (PARTITION BY src) AS p FROM links UNION ALL SELECT 'distrust', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM links),
walk AS (SELECT 0 AS i, 'trust' AS kind, host, CAST(a / (SELECT sum(a) FROM c) AS DOUBLE) AS d FROM c WHERE a > 0 UNION ALL SELECT 0, 'distrust', host, CAST(b / (SELECT sum(b) FROM c) AS DOUBLE) FROM c WHERE b > 0
  UNION ALL SELECT * FROM (SELECT i + 1, kind, dst, sum(0.85 * d * p) FROM walk JOIN steps USING (kind) WHERE host = src AND i < 160 GROUP BY ALL)),
s AS (SELECT host, coalesce(sum(d) FILTER (kind = 'trust') / (SELECT sum(d) FROM walk WHERE kind = 'trust'), 0) AS trust, coalesce(sum(d) FILTER (kind = 'distrust') / (SELECT sum(d) FROM walk WHERE kind = 'distrust'), 0) AS distrust FROM walk GROUP BY 1),
tried AS (SELECT power(2.0, i) AS ratio FROM range(-8, 9) r(i)),
scored AS (SELECT ratio, coalesce(sum(b) FILTER (distrust > trust * ratio * 1.000001) / nullif(sum(b), 0), 0) + coalesce(sum(a) FILTER (distrust <= trust * ratio * 1.000001) / nullif(sum(a), 0), 0) AS v FROM c JOIN s USING (host), tried GROUP BY 1),
best AS (SELECT coalesce((SELECT ratio FROM scored ORDER BY round(v, 9) DESC, greatest(ratio, 1 / ratio), ratio LIMIT 1), 1) AS ratio)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) * ratio * 1.000001 THEN 'block' ELSE 'allow' END) AS verdict FROM j LEFT JOIN s USING (host), best
"""


def op3_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack every document into sequences of at most 1024 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), BYTE_BPE)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every document by its rule statistics."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge_quality(docs, table(spark, sf_dir, "labels")).select(
        "doc_id",
        *quality.STATS,
        "base_failed",
        "kept",
        "score",
    )


#: What both turns of the added conversation -1 say.
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def turn_events(turns: DataFrame) -> DataFrame:
    """A log (conv_id, seq, target, role, kind, text) from which folding gives the rows of turns (conv_id, turn, role,
    text) back: by the hash of a row, its text comes as a message and deltas, as a draft that an edit replaces, as an
    answer that is begun, regenerated and streamed anew, or as a draft whose edit comes three turns later."""
    text, third = F.coalesce("text", F.lit("")), F.ceil(F.length("text") / 3).cast("int")
    a, b, c = F.substring(text, F.lit(1), third), F.substring(text, third + 1, third), F.substring(
        text,
        2 * third + 1,
        F.length(text),
    )
    log = lambda *events: F.array(*(F.struct(F.lit(k).alias("kind"), F.coalesce(t, F.lit("")).alias("text")) for k, t in events))
    streamed = log(("message", a), ("delta", b), ("delta", c))
    edited = log(("message", F.reverse(text)), ("delta", F.lit("<|draft|>")), ("edit", text))
    anew = log(("message", b), ("delta", c), ("regenerate", F.lit("")), ("delta", a), ("delta", b), ("delta", c))
    late = log(("message", F.reverse(text)), ("late", text))
    way = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4))
    # Rows of one turn number follow one another, by role and text, each with its own events; no turn number comes first.
    row = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy(F.coalesce("role", F.lit("")), text))
    logs = turns.withColumns(
        {"row": row, "events": F.when(way == 0, streamed).when(way == 1, edited).when(way == 2, anew).otherwise(late)},
    )
    wide = lambda x: x.cast("decimal(20,0)")
    turn = F.coalesce(wide(F.col("turn")), F.lit(str(-(1 << 63) - 1)).cast("decimal(20,0)"))
    place = lambda t, at: (t * F.lit(1 << 40).cast("decimal(14,0)") + wide(F.col("row") * 8 + at)).cast("decimal(38,0)")
    each = logs.select("conv_id", turn.alias("t"), "role", "row", F.posexplode("events").alias("at", "e"))
    is_late = F.col("e.kind") == "late"
    return each.select(
        "conv_id",
        F.when(is_late, place(F.col("t") + 3, F.lit(7))).otherwise(place(F.col("t"), F.col("at"))).alias("seq"),
        F.when(is_late, place(F.col("t"), F.lit(0))).alias("target"),
        "role",
        F.when(is_late, "edit").otherwise(F.col("e.kind")).alias("kind"),
        "e.text",
    )


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format every conversation, and one made of control strings, and read the turns back; turns come from event logs."""
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    rendered = chat.render(chat.fold_events(turn_events(own.unionByName(added)), width=chat.CHUNK * 2.0**40))
    read = rendered.select(
        "conv_id",
        "formatted",
        chat.read_back(F.col("formatted")).alias("turns"),
        chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    )
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP5_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\' || chr(10)))
    + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove the lines of every document that resemble an earlier line."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select(
        "doc_id",
        "n_lines",
        "n_removed",
        F.sha2("text", 256).alias("kept_sha256"),
    )


#: Pairs of lines come from the words they share; that is quadratic in a word's lines, and fit for small tables only.
OP6_SQL = r"""
WITH l AS (SELECT doc_id, CAST(i AS BIGINT) AS line_no, x[i] AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents), unnest(range(1, len(x) + 1)) r(i)),
w AS (SELECT *, list_sort(list_distinct(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda t: t <> ''))) AS words FROM l),
s AS (SELECT words, min((doc_id, line_no)) AS first, len(words) AS n, row_number() OVER (ORDER BY min((doc_id, line_no))) AS k FROM w WHERE len(words) > 0 GROUP BY words),
e AS (SELECT k, n, unnest(words) AS t FROM s),
p AS (SELECT a.k, b.k AS other, any_value(a.n + b.n) AS n, count(*) AS shared FROM e a JOIN e b ON a.t = b.t AND b.k < a.k AND 10 * b.n >= 8 * a.n AND 10 * a.n >= 8 * b.n GROUP BY a.k, b.k),
m AS (SELECT DISTINCT k FROM p WHERE 18 * shared >= 8 * n),
g AS (SELECT w.doc_id, w.line_no, w.line, coalesce(m.k IS NOT NULL OR (w.doc_id, w.line_no) > s.first, false) AS gone FROM w LEFT JOIN s USING (words) LEFT JOIN m USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone), '')) AS kept_sha256 FROM g GROUP BY doc_id
"""


def op7_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove the bytes of 50-byte strings that also start in a smaller document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix.remove_repeats(docs).select(
        "doc_id",
        "n_bytes",
        "n_removed",
        "n_spans",
        F.sha2("kept_bytes", 256).alias("kept_sha256"),
    )


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the ids of every document to token files and read them back."""
    path = token_store.store_folder(spark)
    token_store.write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), BYTE_BPE, path)
    return token_store.read_tokens(spark, path)


def op9_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group documents whose shingle sets are alike to 85 %."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint every text, and its edited text, whose last third comes from the next document."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = fingerprints.with_next(
        docs,
        "doc_id",
        "text",
        {"sketch": fingerprints.sketch(F.col("text"))},
        parts,
    ).withColumn("n_chars", F.length("text").cast("long"))
    cut_off = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut_off),
        F.substring("next_text", F.lit(1), cut_off),
    )
    sketched = pairs.select("doc_id", "n_chars", "sketch", "next_sketch", edited.alias("edited")).withColumn(
        "own",
        F.struct("edited", fingerprints.sketch(F.col("edited")).alias("sketch")),
    )
    return sketched.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.fingerprint(F.col("sketch")).alias("fingerprint"),
        fingerprints.fingerprint(F.col("own.sketch")).alias("edited_fingerprint"),
        fingerprints.resemblance(F.col("sketch"), F.col("own.sketch")).alias("near_edited"),
        fingerprints.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        fingerprints.containment(F.col("sketch"), F.col("own.sketch")).alias("held_in_edited"),
        fingerprints.distinct_shingles(F.col("sketch")).alias("distinct_shingles"),
    )


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every 20th embedding."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


OP11_SQL = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score FROM e q JOIN e c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding along the 32 components of most variance, whitened."""
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def periodic_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of op13: those of every tenth document (by crc32 of its id) repeat from some word on with some period."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of words of every document, and its text without what they repeat."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = runs.find_runs(docs, rewrite=periodic_tail)
    # The longest run, then the one that begins first, then the one of the least period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length, -r.start, -r.period)))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    return found.select("doc_id", "n_words", "runs", "collapsed", best.alias("best")).select(
        "doc_id",
        "n_words",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.col2")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.col3")).alias("period"),
        F.expr("1000 * best.length DIV -best.col3").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_round_trip": op1_bpe_round_trip,
    "op2_url_filter": op2_url_filter,
    "op3_pack_sequences": op3_pack_sequences,
    "op4_quality_rules": op4_quality_rules,
    "op5_chat_format": op5_chat_format,
    "op6_line_dedup": op6_line_dedup,
    "op7_suffix_repeats": op7_suffix_repeats,
    "op8_token_files": op8_token_files,
    "op9_minhash_near_duplicates": op9_minhash_near_duplicates,
    "op10_fingerprints": op10_fingerprints,
    "op11_nearest_neighbours": op11_nearest_neighbours,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_periodic_runs": op13_periodic_runs,
}

#: DuckDB SQL for those queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op2_url_filter": OP2_SQL,
    "op5_chat_format": OP5_SQL,
    "op6_line_dedup": OP6_SQL,
    "op11_nearest_neighbours": OP11_SQL,
}
