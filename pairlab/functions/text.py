"""Column functions and row filters over records with text."""

from __future__ import annotations

import ast
import difflib
import hashlib
import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Language aliases.
LANGUAGES = {
    "c": "C",
    "c++": "C++",
    "cpp": "C++",
    "python": "Python",
    "java": "Java",
    "javascript": "JavaScript",
    "js": "JavaScript",
}

# Words that speak for a security patch.
SECURITY_WORDS = [
    "cve-", "vulnerability", "vuln", "security", "exploit", "overflow",
    "injection", "xss", "csrf", "rce", "sqli", "buffer", "heap", "stack",
    "uaf", "use-after-free", "null deref", "null pointer", "integer overflow",
    "out-of-bounds", "oob", "memory corruption", "privilege escalation",
    "arbitrary code", "denial of service", "dos", "authentication bypass",
    "insecure", "crypto", "cipher", "hash", "random", "entropy", "prng",
    "deserialization", "path traversal", "directory traversal", "fix",
    "patch", "sanitize", "validate", "hardening",
]

# Words that speak against one.
OTHER_WORDS = [
    "refactor", "reformat", "style", "typo", "whitespace", "indent",
    "comment", "doc", "documentation", "test", "unittest", "benchmark",
    "performance", "optimize", "cleanup", "clean up", "rename", "move file",
    "add feature", "new feature", "release", "version bump", "changelog",
    "merge branch", "revert",
]


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mapped(key: Column, values: dict[str, str]) -> Column:
    """The value for key, or null."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def keep_categories(df: DataFrame, col: str, categories: list[str]) -> DataFrame:
    return df.where(F.col(col).isin(categories))


def normalize_language(col: Column | str, aliases: dict[str, str] = LANGUAGES) -> Column:
    """The common name of a language by aliases (lower case); blank or null is Unknown, other names get one capital, at
    their start."""
    name = F.lower(F.trim(column(col)))
    capital = F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, F.lit(2), F.length(name)))
    return F.when(F.coalesce(name, F.lit("")) == "", "Unknown").otherwise(F.coalesce(mapped(name, aliases), capital))


def standardize_pairs(df: DataFrame, defaults: dict[str, object], own: str, augmented: str, seed: str) -> DataFrame:
    """Fill missing fields; the seed id is a raw row's own id and an augmented row's recorded one."""
    filled = df.withColumns(
        {c: F.coalesce(F.col(c) if c in df.columns else F.lit(None), F.lit(v)) for c, v in defaults.items()},
    )
    return filled.withColumn(
        seed,
        F.when(F.coalesce(F.col(augmented), F.lit(False)), F.col(seed)).otherwise(F.col(own)),
    )


def not_blank(col: Column | str) -> Column:
    """Has a character that is no white space; false for null."""
    return F.coalesce(column(col).rlike(r"\S"), F.lit(False))


def drop_blank_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(not_blank(a) & not_blank(b))


def nonblank_lines(col: Column | str) -> Column:
    return F.coalesce(F.size(F.filter(F.split(column(col), r"\r?\n"), lambda x: x.rlike(r"\S"))), F.lit(0))


def min_nonblank_lines(df: DataFrame, cols: list[str], n: int) -> DataFrame:
    return df.where(reduce(lambda x, y: x & y, [nonblank_lines(c) >= n for c in cols]))


def truncate_lines(col: Column | str, most: int = 40, marker: str = "... [truncated] ...") -> Column:
    """Texts of more than `most` lines keep their first and last halves of that many, with a marker between."""
    lines, half = F.split(column(col), "\n"), most // 2
    cut = F.concat(F.slice(lines, 1, half), F.array(F.lit(marker)), F.slice(lines, -half, half))
    return F.when(F.size(lines) > most, F.array_join(cut, "\n")).otherwise(column(col))


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that is violated (its condition holds), or null."""
    chain = reduce(lambda acc, r: acc.when(r[1], r[0]) if acc is not None else F.when(r[1], r[0]), rules, None)
    return chain.otherwise(F.lit(None).cast("string"))


def filter_funnel(df: DataFrame, rules: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """The rows that no rule rejects, and the number of rows for each first reason (kept for the rest)."""
    judged = df.withColumn("reason", first_reason(rules))
    return judged.where("reason IS NULL").drop("reason"), judged.groupBy(
        F.coalesce("reason", F.lit("kept")).alias("reason"),
    ).agg(F.count("*").alias("n"))


def tag_role(df: DataFrame, col: str, roles: DataFrame) -> DataFrame:
    """Add the role of a category from a taxonomy (category, role); others are unassigned."""
    known = roles.select(F.col("category").alias("__c"), "role")
    return df.join(known, F.col(col) == F.col("__c"), "left").drop("__c").withColumn(
        "role",
        F.coalesce("role", F.lit("unassigned")),
    )


def emptiness(col: Column | str) -> Column:
    c = column(col)
    return F.when(c.isNull() | (c == ""), "empty").when(~c.rlike(r"\S"), "whitespace_only").otherwise("non_empty")


# Statuses of a generation.
SOUND = ["SUCCESS", "WHITESPACE_ONLY"]
FAILURES = {"hook": "HOOK_EXCEPTION", "generation": "GENERATION_EXCEPTION", "malformed": "MALFORMED_GENERATION"}


def failure_class(status: Column) -> Column:
    """hook, generation, malformed or other (any status that isn't known, null too); null for a sound generation."""
    known = reduce(
        lambda acc, f: acc.when(status == f[1], f[0]),
        FAILURES.items(),
        F.when(status.isin(SOUND), F.lit(None).cast("string")),
    )
    return known.otherwise("other")


def failure_counts(df: DataFrame, keys: list[str], status: Column, fallback: Column) -> DataFrame:
    """Failed generations by class and, apart from them, fallbacks: every row whose fallback is not NONE, null too."""
    marked = df.withColumns({"__f": failure_class(status), "__b": ~F.coalesce(fallback == "NONE", F.lit(False))})
    classes = [F.count_if(F.col("__f") == x).alias(f"n_{x}") for x in (*FAILURES, "other")]
    return marked.groupBy(*keys).agg(F.count("*").alias("n"), *classes, F.count_if("__b").alias("n_fallback"))


def looks_like_code(col: Column | str, tokens: list[str], least: int = 10) -> tuple[Column, Column, Column]:
    """Whether a text is long enough and has a code token; the reason if not; the first token it has."""
    c = F.coalesce(column(col), F.lit(""))
    first = F.coalesce(*(F.when(F.contains(c, F.lit(t)), F.lit(t)) for t in tokens))
    short = F.length(F.trim(c)) < least
    return ~short & first.isNotNull(), F.when(short, "too_short").when(first.isNull(), "no_code_token"), first


def scan_eligible(language: Column | str, text: Column | str, supported: list[str]) -> Column:
    """A record can be scanned; others are skipped, which is not the same as safe."""
    return F.coalesce(column(language).isin(supported), F.lit(False)) & not_blank(text)


def eligible_population(df: DataFrame, allowed: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose keys are allowed, and the number of rows in each stratum that isn't."""
    chosen = allowed.select(*keys).distinct()
    return df.join(
        chosen,
        keys,
        "left_semi",
    ), df.join(chosen, keys, "left_anti").groupBy(*keys).agg(F.count("*").alias("n"))


def export_metadata(df: DataFrame, texts: list[str], order: str) -> DataFrame:
    """Replace texts by their digests and the pair's digest; order stays as source_order."""
    digests = {f"{c}_sha256": F.sha2(c, 256) for c in texts}
    out = df.withColumns(digests).withColumn(
        "pair_sha256",
        pair_digest(*texts),
    ) if len(texts) == 2 else df.withColumns(digests)
    return out.withColumnRenamed(order, "source_order").drop(*texts)


def classify_patch(
    msg: Column | str,
    linked: Column,
    security: list[str] = SECURITY_WORDS,
    other: list[str] = OTHER_WORDS,
) -> Column:
    """security_patch, non_security_patch or undecidable, for a commit message and whether the commit is linked to a
    vulnerability, by how many words of either list the message holds. A missing or empty message is decided by the link."""
    low, tied = F.lower(column(msg)), F.coalesce(linked, F.lit(False))
    hits = lambda words: F.size(F.filter(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(low, w)))

    def by_hits(counts: Column) -> Column:
        own, rest = counts.own, counts.rest
        return (
            F.when(low.rlike(r"cve-\d{4}-\d+") | (tied & (own > 0)), "security_patch")
            .when(tied & (own == 0) & (rest > own), "undecidable")
            .when(~tied & (rest > 0) & (own == 0), "non_security_patch")
            .when(own > rest, "security_patch").when(rest > own, "non_security_patch").otherwise("undecidable")
        )

    counted = F.transform(F.array(F.struct(hits(security).alias("own"), hits(other).alias("rest"))), by_hits)
    return F.when(
        F.coalesce(low, F.lit("")) == "",
        F.when(tied, "security_patch").otherwise("undecidable"),
    ).otherwise(F.get(counted, F.lit(0)))


def hunk_id(key: Column, path: Column, code: Column, chars: int = 200) -> Column:
    return F.md5(
        F.concat_ws(
            "|",
            F.coalesce(key.cast("string"), F.lit("")),
            F.coalesce(path, F.lit("")),
            F.coalesce(F.substring(code, 1, chars), F.lit("")),
        ),
    )


def pair_digest(a: Column | str, b: Column | str) -> Column:
    return F.sha2(F.concat(F.sha2(column(a), 256), F.lit(":"), F.sha2(column(b), 256)), 256)


def ordered_digest(df: DataFrame, keys: list[str], ident: str, order: str, per: int = 1000) -> DataFrame:
    """A digest of each group's ids in order, over the digests of buckets of `per` order values (so groups may be large)."""
    bucket = F.floor(F.col(order) / per)
    parts = df.groupBy(*keys, bucket.alias("__b")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order), F.col(ident).alias("i")))).alias("v"),
    )
    small = parts.select(
        *keys,
        "__b",
        F.sha2(F.array_join(F.transform("v", lambda x: x.i.cast("string")), ","), 256).alias("d"),
        F.size("v").alias("n"),
    )
    whole = small.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("__b", "d"))).alias("v"),
        F.sum("n").alias("n_ids"),
    )
    return whole.select(
        *keys,
        "n_ids",
        F.sha2(F.array_join(F.transform("v", lambda x: x.d), ","), 256).alias("digest"),
    )


#: Ids that are written into one piece of a list's text.
PIECE = 20_000


def canonical_digest(df: DataFrame, keys: list[str], ident: str, order: str) -> DataFrame:
    """(keys, n_ids, digest): the SHA-256 of each group's ids, in order (ties by id), as one JSON list without blanks.

    A digest of this kind goes through its bytes one after another. Sorting and writing JSON are spread, by ranges of
    group and order, and give pieces of PIECE ids; then one pass for each group takes its pieces in turn, of which it
    holds one at a time. Null ids are null in the list.
    """
    by = [f"k{i}" for i in range(len(keys))]
    fields = [T.StructField(b, df.schema[k].dataType) for b, k in zip(by, keys, strict=True)]
    n = len(by)
    chosen = df.select(*(F.col(k).alias(b) for k, b in zip(keys, by, strict=True)), F.col(order).alias("o"), F.col(ident).alias("i"))
    ranged = chosen.repartitionByRange(*by, "o", "i").sortWithinPartitions(*by, "o", "i")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            group = list(zip(*(c.to_pylist() for c in batch.columns[:n]), strict=True)) if n else [()] * batch.num_rows
            ids = batch.column(n + 1).to_pylist()
            at = 0
            while at < len(ids):
                end = at + 1
                while end < len(ids) and end - at < PIECE and group[end] == group[at]:
                    end += 1
                text = json.dumps(ids[at:end], separators=(",", ":"), ensure_ascii=False)[1:-1]
                row = [*group[at], (part << 40) + number, end - at, text]
                yield pa.RecordBatch.from_pylist([dict(zip(piece_schema.names, row, strict=True))], schema=piece_arrow)
                at, number = end, number + 1

    piece_schema = T.StructType([*fields, T.StructField("place", T.LongType()), T.StructField("n", T.LongType()), T.StructField("text", T.StringType())])
    piece_arrow = to_arrow_schema(piece_schema)
    out_schema = T.StructType([*fields, T.StructField("n_ids", T.LongType()), T.StructField("digest", T.StringType())])
    out_arrow = to_arrow_schema(out_schema)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, count = None, None, 0

        def ended() -> Iterator[pa.RecordBatch]:
            if state is not None:
                state.update(b"]")
                row = [*now, count, state.hexdigest()]
                yield pa.RecordBatch.from_pylist([dict(zip(out_schema.names, row, strict=True))], schema=out_arrow)

        for batch in batches:
            for row in batch.to_pylist():
                group = tuple(row[b] for b in by)
                if state is None or group != now:
                    yield from ended()
                    now, state, count = group, hashlib.sha256(b"["), 0
                state.update((b"," if count else b"") + row["text"].encode())
                count += row["n"]
        yield from ended()

    written = ranged.mapInArrow(pieces, piece_schema)
    dealt = written.repartition(*by) if by else written.repartition(1)  # pieces only
    found = dealt.sortWithinPartitions(*by, "place").mapInArrow(digests, out_schema)
    return found.select(*(F.col(b).alias(k) for b, k in zip(by, keys, strict=True)), "n_ids", "digest")


def augment_by_substitution(
    df: DataFrame,
    subs: DataFrame,
    language: str,
    text: str,
    ident: str,
    templates: DataFrame | None = None,
) -> DataFrame:
    """Pairs made by replacing literals: rows with the insecure literal give (row, secured), rows with the secure one
    (weakened, row). subs has language, insecure, secure; templates, a table of the same columns, is unioned in."""
    rules = subs.select(F.col("language").alias("__l"), "insecure", "secure")
    hit = df.join(rules, F.col(language) == F.col("__l"))
    forward = hit.where(F.contains(text, "insecure")).withColumns(
        {
            "vulnerable_text": F.col(text),
            "fixed_text": F.replace(F.col(text), F.col("insecure"), F.col("secure")),
            "direction": F.lit("secured"),
        },
    )
    back = hit.where(F.contains(text, "secure")).withColumns(
        {
            "vulnerable_text": F.replace(F.col(text), F.col("secure"), F.col("insecure")),
            "fixed_text": F.col(text),
            "direction": F.lit("weakened"),
        },
    )
    made = forward.unionByName(back).select(
        F.col(ident).cast("string").alias("seed_id"),
        F.col(language).alias("language"),
        "vulnerable_text",
        "fixed_text",
        "direction",
    )
    made = made.withColumn(
        "pair_id",
        F.md5(F.concat_ws("|", "seed_id", F.md5("vulnerable_text"), F.md5("fixed_text"))),
    )
    return (
        made.unionByName(templates, allowMissingColumns=True) if templates is not None else made
    ).dropDuplicates(["pair_id"])


# A fenced block, and a line that only names a role.
FENCED = r"(?s)```[^\r\n]*\r?\n(.*?)(?:\r?\n```|```)"
ROLE_LINE = r"(?im)^\s*(?:<\|)?(?:assistant|system|user)(?:\|>)?\s*:?\s*$"


def extract_fenced(col: Column | str, mode: str = "first") -> Column:
    """Code inside fences of three backticks: the first complete block, or the lines of all blocks; without a fence the text."""
    c = F.coalesce(column(col), F.lit(""))
    if mode == "first":
        return F.when(c.rlike(FENCED), F.regexp_extract(c, FENCED, 1)).otherwise(c)
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("lines"))
    step = lambda a, x: F.when(F.startswith(F.ltrim(x), F.lit("```")), F.struct((~a.inside).alias("inside"), a.lines.alias("lines"))).otherwise(
        F.struct(a.inside.alias("inside"), F.when(a.inside, F.concat(a.lines, F.array(x))).otherwise(a.lines).alias("lines")))
    return F.when(
        F.contains(c, F.lit("```")),
        F.aggregate(F.split(c, "\n"), start, step, lambda a: F.array_join(a.lines, "\n")),
    ).otherwise(c)


def content_flags(col: Column | str, starts: list[str]) -> dict[str, Column]:
    """What interface content a text has: a fence, a role marker (``<|`` anywhere, or a line that only names a role), no
    visible character, a first line with text that starts with one of starts without indent, and a block to extract."""
    c = F.coalesce(column(col), F.lit(""))
    first = F.coalesce(F.get(F.filter(F.split(c, r"\r?\n"), lambda x: x.rlike(r"\S")), F.lit(0)), F.lit(""))
    begins = reduce(lambda a, b: a | b, [F.startswith(first, F.lit(s)) for s in starts])
    return {
        "has_fence": F.contains(c, F.lit("```")),
        "has_role_marker": F.contains(c, F.lit("<|")) | c.rlike(ROLE_LINE),
        "is_blank": ~c.rlike(r"\S"),
        "starts_with_token": begins,
        "changed_by_extraction": extract_fenced(c) != c,
    }


def content_audit(df: DataFrame, keys: list[str], col: str, starts: list[str]) -> DataFrame:
    flags = content_flags(col, starts)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *(F.count_if(c).alias(f"n_{k}") for k, c in flags.items()))


def choice_letter(col: Column | str) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(F.upper(column(col)), "[ABCD]", 0), F.lit("")), F.lit("X"))


@F.pandas_udf(T.BooleanType())
def py_syntax_ok(codes: pd.Series) -> pd.Series:
    """Whether a text parses as Python; null and blank texts don't count as valid."""

    def ok(code: str | None) -> bool:
        try:
            return bool(code and code.strip()) and ast.parse(code) is not None
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return False

    return codes.map(ok).astype(bool)


@F.pandas_udf(T.StringType())
def line_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    """A unified diff without its header."""
    return pd.Series(
        [
            "\n".join(
                list(difflib.unified_diff((x or "").split("\n"), (y or "").split("\n"), lineterm="", n=0))[2:],
            ) for x, y in zip(a, b, strict=True)
        ],
    )


def changed_line_counts(a: Column | str, b: Column | str) -> tuple[Column, Column]:
    """Distinct lines that only the first, and only the second text has."""
    x, y = (F.split(F.coalesce(column(c), F.lit("")), "\n") for c in (a, b))
    return F.size(F.array_except(x, y)), F.size(F.array_except(y, x))


def rate_text(col: Column | str, digits: int = 6) -> Column:
    return F.format_string(f"%.{digits}f", column(col).cast("double"))


def secret_scan(df: DataFrame, ident: str, col: str, patterns: list[tuple[str, str]]) -> DataFrame:
    """One row for each record and pattern (name, pattern) found in it. Patterns are constants, so each is compiled once
    and every text is read in one pass without a join."""
    found = F.array_compact(F.array(*(F.when(F.col(col).rlike(p), F.lit(n)) for n, p in patterns)))
    return df.select(ident, F.explode(found).alias("name"))
