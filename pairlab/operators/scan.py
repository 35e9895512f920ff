"""Scanning records with rules, and summaries of the findings."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FINDINGS = "array<struct<category:string,rule_id:string>>"
#: Ends of words of \w, and places that are none; a character of \w that a pattern needs, where the start of a word is cheaper to see.
BOUNDARIES = {r"\b": r"(?:(?=\w)(?<!\w)|(?!\w)(?<=\w))", r"\B": r"(?:(?=\w)(?<=\w)|(?!\w)(?<!\w))"}
WORD_NEXT = re.compile(r"(?:\\[dw]|[^\WKSks])(?:\{[1-9]|(?![?*{]))", re.ASCII)  # other letters may fold to K and S


def ascii_boundaries(pattern: str) -> str:
    r"""A pattern with \b and \B for words of \w: ASCII letters, digits and _. So they are in RE2 and in Java from 19 on; in
    Java before, letters of every script count and `tion\b` is in "tioné" not found. Quoted text, classes and \b{g} stay."""
    out, depth = [], 0
    for m in re.finditer(r"\\Q.*?(?:\\E|\Z)|\\b\{g\}|\\.|\[\^?\]?|.", pattern, re.DOTALL):
        part = m.group()
        depth += 1 if part[0] == "[" else -1 if part == "]" and depth else 0
        if depth or part not in BOUNDARIES:
            out.append(part)
        else:
            out.append(r"(?<!\w)" if part == r"\b" and WORD_NEXT.match(pattern, m.end()) else BOUNDARIES[part])
    return "".join(out)


def scan_rules(text: Column | str, rules: list[tuple[str, str, str]]) -> Column:
    """Findings of a text, as array<struct<category, rule_id>>: for each category the first of its rules (category,
    rule_id, pattern) that matches. Static rules make one expression, so a scan needs no join."""
    c = F.col(text) if isinstance(text, str) else text
    by: dict[str, list[tuple[str, str]]] = {}
    for category, rule, pattern in rules:
        by.setdefault(category, []).append((rule, pattern))
    first = []
    for category, own in by.items():
        rule = F.coalesce(*(F.when(c.rlike(ascii_boundaries(p)), F.lit(r)) for r, p in own))
        first.append(F.when(rule.isNotNull(), F.struct(F.lit(category).alias("category"), rule.alias("rule_id"))))
    return F.array_compact(F.array(*first)).cast(FINDINGS)


def required_literal(pattern: str) -> str:
    """The longest text that a regular expression can't match without, as far as it is plain to see; empty if there is none.

    Only characters outside of groups, classes and repetitions that may be none count; a pattern with alternatives or
    flags has no required literal.
    """
    best = now = ""
    depth, i, n = 0, 0, len(pattern)

    def end() -> None:
        nonlocal best, now
        best, now = max(best, now, key=len), ""

    while i < n:
        c = pattern[i]
        if pattern.startswith("(?", i) and not pattern.startswith(("(?:", "(?=", "(?!", "(?<"), i) or (c == "|" and not depth):
            return ""
        if c == "\\":
            two = pattern[i + 1 : i + 2]
            if two.isalnum() and two:
                if two in "QEpPxuckN0123456789":  # quoted, named and numbered characters aren't read
                    return ""
                end()
            elif not depth:
                now += two
            i += 2
            continue
        if c == "[":
            end()
            i += 2 if pattern.startswith(("[^", "[]"), i) else 1
            i += pattern.startswith("]", i)
            inner = 1
            while i < n and inner:
                inner += (pattern[i] == "[") - (pattern[i] == "]")
                i += 2 if pattern[i] == "\\" else 1
            continue
        if c in "(":
            end()
            depth += 1
        elif c == ")":
            depth -= 1
        elif c in "?*{":
            now = now[:-1]  # the character before may be missing
            end()
            i = pattern.find("}", i) if c == "{" else i
            if i < 0:
                return ""
        elif c in "+.^$":
            end()
        elif not depth:
            now += c
        i += 1
    end()
    return best


#: Rules from which on texts are looked through for literals first.
MANY_RULES = 64


def candidate_rules(df: DataFrame, text: str, literals: list[str]) -> DataFrame:
    """Add __rules, the places (from 0) of those literals that a text contains, found in one pass over it."""
    schema = T.StructType([*df.schema.fields, T.StructField("__rules", T.ArrayType(T.IntegerType()))])
    at = df.columns.index(text)
    by: dict[str, list[int]] = {}
    for i, literal in enumerate(literals):
        by.setdefault(literal, []).append(i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ahocorasick.Automaton()
        for literal, places in by.items():
            index.add_word(literal, places)
        index.make_automaton()
        for batch in batches:
            found = [sorted({i for _, places in index.iter(t) for i in places}) if t else [] for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], names=schema.names)

    return df.mapInArrow(run, schema)


def scan_rule_table(df: DataFrame, ident: str, text: str, rules: DataFrame, most: int = 100_000) -> DataFrame:
    """As scan_rules, for a table of rules (category, rule_order, rule_id, pattern): one row per record and category.

    Rules are a parameter that people write; their table is read (more than `most` raise). A few are made constants of one
    expression. Of many, only those meet a text whose required literal it contains: an automaton of all literals finds
    them in one pass, so their cost follows the text and its hits, not the number of rules. Rules without a literal of
    three characters stay in the expression.
    """
    rows = rules.orderBy("rule_order").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules")
    triples = [(r["category"], r["rule_id"], ascii_boundaries(r["pattern"])) for r in rows]
    literals = [required_literal(r["pattern"]) for r in rows]
    if len(rows) < MANY_RULES or max(map(len, literals)) < 3:
        found = scan_rules(text, triples)
        return df.select(ident, F.explode(found).alias("f")).select(ident, "f.category", "f.rule_id")
    indexed = [i for i, x in enumerate(literals) if len(x) >= 3]
    table = df.sparkSession.createDataFrame([(n, i, *triples[i]) for n, i in enumerate(indexed)], "n int, place int, category string, rule_id string, pattern string")
    texts = df.select(F.col(ident).alias("__id"), F.col(text).alias("__text"))
    hits = candidate_rules(texts, "__text", [literals[i] for i in indexed]).select("__id", "__text", F.explode("__rules").alias("n"))
    # At most `most` rules of some hundred bytes.
    one = hits.join(F.broadcast(table), "n").where(F.expr("__text RLIKE pattern")).select("__id", "category", "place", "rule_id")
    rest = [i for i, x in enumerate(literals) if len(x) < 3]
    if rest:
        each = F.array_compact(F.array(*(F.when(F.col("__text").rlike(triples[i][2]), F.struct(F.lit(triples[i][0]).alias("category"), F.lit(i).alias("place"), F.lit(triples[i][1]).alias("rule_id"))) for i in rest)))
        one = one.unionByName(texts.select("__id", F.explode(each).alias("f")).select("__id", "f.category", "f.place", "f.rule_id"))
    first = one.groupBy("__id", "category").agg(F.min_by("rule_id", "place").alias("rule_id"))
    return first.withColumnRenamed("__id", ident)


def part_grams(text: Column, lengths: list[int]) -> Column:
    """All different parts of a text that have one of a few lengths."""

    def of_length(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(text) - n + 1)
        return F.when(F.length(text) >= n, F.transform(starts, lambda i: F.substring(text, i, F.lit(n))))

    return F.array_distinct(F.flatten(F.array_compact(F.array(*map(of_length, lengths)))))


def map_rules(findings: DataFrame, mapping: DataFrame, gram: int = 3) -> DataFrame:
    """Add the category of external rule ids: the one mapped exactly, else that of the first (by order) whose rule_id is
    part of it; null if there is none. mapping has rule_id, category, order.

    A mapped id can only be part of ids that have its first `gram` characters (or all, of a shorter one) somewhere, so
    distinct ids meet mapped ones by these alone."""
    rules = mapping.select(
        F.col("rule_id").alias("__r"),
        F.col("category").alias("__c"),
        F.col("order").alias("__o"),
        F.substring("rule_id", 1, gram).alias("__g"),
    )
    known = findings.select("rule_id").distinct().where("rule_id IS NOT NULL")
    parts = known.withColumn("__g", F.explode(F.concat(F.array(F.lit("")), part_grams(F.col("rule_id"), list(range(1, gram + 1))))))
    hit = parts.join(rules, "__g").where(F.contains("rule_id", "__r"))
    best = hit.groupBy("rule_id").agg(
        F.min_by("__c", F.struct((F.col("rule_id") != F.col("__r")).alias("part"), "__o")).alias("category"),
    )
    return findings.join(best, "rule_id", "left")


def merge_findings(a: Column, b: Column) -> Column:
    """The findings of two scanners, first ones kept where category and rule repeat."""
    empty = F.array().cast(FINDINGS)
    return F.array_distinct(F.concat(F.coalesce(a, empty), F.coalesce(b, empty)))


def derive_flags(df: DataFrame, findings: str, derivation: list[str], target: str) -> DataFrame:
    """Add detected, is_vulnerable (any detected category counts for derivation), target_present and any_finding."""
    detected = F.array_sort(F.array_distinct(F.transform(findings, lambda x: x.category)))
    known = F.array(*(F.lit(c) for c in derivation)).cast("array<string>")
    out = df.withColumn("detected", F.coalesce(detected, F.array().cast("array<string>")))
    return out.withColumns(
        {
            "is_vulnerable": F.arrays_overlap("detected", known),
            "target_present": F.array_contains("detected", F.col(target)),
            "any_finding": F.size("detected") > 0,
        },
    )


def rules_fingerprint(rules: list[tuple[str, str, str]]) -> Column:
    """A digest of the rules in order, as they are matched, to tell whether records were scanned with the same ones."""
    return F.sha2(F.lit("\n".join("\t".join((c, r, ascii_boundaries(p))) for c, r, p in rules)), 256)


def scan_incremental(
    new: DataFrame,
    done: DataFrame,
    ident: str,
    text: str,
    rules: list[tuple[str, str, str]],
) -> DataFrame:
    """Findings of those records that done (ident, rules_hash) doesn't have with the same rules."""
    hashed = new.withColumn("rules_hash", rules_fingerprint(rules))
    fresh = hashed.join(done.select(ident, "rules_hash"), [ident, "rules_hash"], "left_anti")
    return fresh.select(ident, "rules_hash", scan_rules(text, rules).alias("findings"))


def prevalence(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if("is_vulnerable").alias("vulnerable"), (F.count_if("is_vulnerable") / F.count("*")).alias("rate"), (F.sum(F.size("findings")) / F.count("*")).alias("findings_per_record")
    )


def category_distribution(df: DataFrame, ident: str, taxonomy: DataFrame) -> DataFrame:
    """Records and findings of every category of taxonomy (category), zeros kept."""
    found = df.select(ident, F.explode(F.transform("findings", lambda x: x.category)).alias("category"))
    counts = found.groupBy("category", ident).agg(F.count("*").alias("n")).groupBy("category").agg(
        F.count("*").alias("records"),
        F.sum("n").alias("findings"),
    )
    return taxonomy.select("category").join(counts, "category", "left").fillna(0, ["records", "findings"])


def co_occurrence(df: DataFrame, detected: str = "detected") -> DataFrame:
    """Counts of unordered pairs of categories that records have together."""
    d = F.array_sort(F.array_distinct(detected))
    pairs = F.flatten(
        F.transform(
            d,
            lambda x: F.transform(F.filter(d, lambda y: x < y), lambda y: F.struct(x.alias("a"), y.alias("b"))),
        ),
    )
    return df.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


def partition_ids(df: DataFrame, ident: str, taxonomy: list[str]) -> DataFrame:
    """(category, id, unsafe) of every record, overall (category null) and for each category."""
    every = F.array(
        F.struct(F.lit(None).cast("string").alias("category"), F.col("any_finding").alias("unsafe")),
        *(F.struct(F.lit(c).alias("category"), F.array_contains("detected", c).alias("unsafe")) for c in taxonomy),
    )
    return df.select(ident, F.explode(every).alias("p")).select("p.category", ident, "p.unsafe")


def hashed(seed: int, key: Column) -> Column:
    """The order in which samples are drawn."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def audit_sample(
    df: DataFrame,
    ident: str,
    category: str,
    sizes: dict[str, int],
    m: int,
    total: int,
    seed: int,
) -> DataFrame:
    """(id, target, picked_as): for each target, in the order of sizes, so many records in which it was detected and m of
    its own category in which it was not, none twice; then records that aren't vulnerable, up to total. Records of lowest
    hash come first. df has the id, category, detected and is_vulnerable.

    One pass takes, for every target and arm, as many records as could be needed if all earlier picks were among them; so
    what is resolved by priority on the driver is bounded by the sizes wanted, whatever the table has.
    """
    spark, wanted = df.sparkSession, sum(sizes.values()) + m * len(sizes)
    h = hashed(seed, F.col(ident))
    arms = [
        F.when(F.array_contains("detected", t), F.struct(F.lit(i).alias("at"), F.lit(0).alias("arm"))).when(
            F.col(category) == t,
            F.struct(F.lit(i).alias("at"), F.lit(1).alias("arm")),
        ) for i, t in enumerate(sizes)
    ]
    exploded = df.select(
        ident,
        h.alias("h"),
        F.explode(F.array_compact(F.array(*arms))).alias("a"),
    ).select(ident, "h", "a.at", "a.arm")
    ranked = exploded.withColumn(
        "r",
        F.row_number().over(Window.partitionBy("at", "arm").orderBy("h", ident)),
    ).where(F.col("r") <= wanted)
    seen, picked = set(), []
    lists: dict[tuple[int, int], list] = {}
    for row in ranked.orderBy("at", "arm", "r").collect():
        lists.setdefault((row["at"], row["arm"]), []).append(row[ident])
    for i, (target, k) in enumerate(sizes.items()):
        free = [[x for x in lists.get((i, arm), ()) if x not in seen][:n] for arm, n in ((0, k), (1, m))]  # both before either is taken
        for name, own in zip(("detected", "not_detected"), free, strict=True):
            picked += [(x, target, name) for x in own]
            seen.update(own)
    spare = df.where(
        ~F.col("is_vulnerable"),
    ).select(ident, h.alias("h")).orderBy("h", ident).limit(total + len(picked)).collect() if len(picked) < total else []
    picked += [
        (x, "none", "padding") for x in [r[ident] for r in spare if r[ident] not in seen][: total - len(picked)]
    ]
    return spark.createDataFrame(
        picked,
        f"`{ident}` {df.schema[ident].dataType.simpleString()}, target string, picked_as string",
    )


def confusion(df: DataFrame, scanner: Column, human: Column, by: list[str]) -> DataFrame:
    """Counts of agreement and the false-positive rate, for each value of by and overall (rollup)."""
    p, t = F.coalesce(scanner, F.lit(False)), F.coalesce(human, F.lit(False))
    counted = df.withColumns({"__p": p, "__t": t}).rollup(*by).agg(
        F.count_if(F.expr("__p AND __t")).alias("tp"), F.count_if(F.expr("__p AND NOT __t")).alias("fp"), F.count_if(F.expr("NOT __p AND __t")).alias("fn"), F.count_if(F.expr("NOT __p AND NOT __t")).alias("tn"))
    return counted.withColumn("fpr", F.try_divide("fp", F.col("fp") + F.col("tn")))
