"""URL filters: rules for hosts and paths, and trust propagated over host links, in built-in functions only.

The longest rule that fits decides. Pages without one are judged by two walks over the links between hosts: trust runs
along links from hosts that allow rules fit (personalised PageRank), distrust runs against them from hosts that block
rules fit, to those that link there. Hosts are linked by their pages' links to other hosts, and each host with the domain
above it, either way, once for each of its pages; so a site's subdomains share what is known of some of them also where
pages link to themselves only. Seeds are weighted by their pages and each walk's seeds add up to one. What a walk brings
to hosts without a link goes back to its seeds, which is what dividing its scores by their sum means.

A host is blocked when its distrust exceeds its trust times ``ratio`` (by more than a millionth of it). Unless it is
given, ratio is calibrated on the pages that rules fit: the power of two by which hosts' scores agree best with the
rules' verdicts, blocked and allowed pages weighing the same, nearest to 1 if there are several. Both walks go on until
they change no host's score relatively, and scores are not rounded, so that verdicts depend neither on the number of
hosts nor on how far a host is from a seed.

Defined cases: a url that is null or has no `://` has an empty host and path, fits no rule and is allowed; a null html
has no links; links of a host to itself (as relative ones are) do not count; hosts that no seed reaches have scores of
0 and are allowed; without pages that rules fit, ratio is 1; repeated rows each give a row and count for the seeds; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.llm.common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Scores that differ by less, relatively, are equal: sums differ by their order, and walks end at a tolerance.
TIE = 1e-6
#: Rounds of a walk between two cuts of its lineage.
ROUNDS = 5
#: A link's target. What lies between the tag's name and the attribute holds no other tag, so broken html is read once.
LINK = r"(?i)<a\s[^<>]*?href\s*=\s*[\"']?([^\"'\s<>]+)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What lies after the first `://`: up to `/`, `?`, `#` or the end with A-Z lower-cased, and on to `?`, `#` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(
        F.regexp_extract(rest, "^([^/?#]*)", 1),
        UPPER,
        LOWER,
    ), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null. For rule lists of a few hundred at most."""
    chain = None
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        chain = F.when(fits, value) if chain is None else chain.when(fits, value)
    return chain if chain is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def join_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Add rule and verdict to (host, path) rows from a rule table of any size (rule, verdict).

    Distinct hosts and paths meet the rules on each suffix of the host; a hot host or rule is split by skew handling.
    """
    own = rules.select("rule", F.col("verdict"), F.substring_index("rule", "/", 1).alias("__h")).withColumn(
        "__p",
        F.expr("substring(rule, length(__h) + 1)"),
    )
    keys = urls.select("host", "path").distinct()
    parts = F.split("host", r"\.")
    names = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."),
    )
    fits = keys.select(
        "host",
        "path",
        F.explode(names).alias("__h"),
    ).join(own, "__h").where(F.startswith("path", "__p"))
    best = fits.groupBy("host", "path").agg(
        F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("b"),
    )
    return urls.join(best.select("host", "path", "b.rule", "b.verdict"), ["host", "path"], "left")


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, counted; pages has host and html."""
    target = F.col("target")
    absolute = F.when(F.startswith(target, F.lit("//")), F.concat(F.lit("x:"), target)).otherwise(target)
    found = pages.where("html IS NOT NULL AND host != ''").select(
        F.col("host").alias("src"),
        F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("target"),
    )
    named = found.where(F.contains("target", F.lit("//"))).select("src", host_and_path(absolute)[0].alias("dst"))
    return named.where("dst != '' AND src != dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def domain_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): each host with the domain right above it, unless that is a top-level one, both ways, and so on up;
    n is the host's number of pages. pages has host."""
    parts = F.split("host", r"\.")
    above = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1),
        lambda i: F.struct(
            F.array_join(F.slice(parts, i, F.size(parts)), ".").alias("src"),
            F.array_join(F.slice(parts, i + 1, F.size(parts)), ".").alias("dst"),
        ),
    )
    named = pages.where("host != ''").groupBy("host").agg(F.count("*").alias("n")).where(F.size(parts) > 2)
    up = named.select(
        "n",
        F.explode(F.slice(above, F.lit(1), F.size(parts) - 2)).alias("l"),
    ).select("l.src", "l.dst", "n")
    return up.unionByName(
        up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"),
    ).where("src != '' AND dst != ''").groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(seeds: DataFrame, links: DataFrame, damping: float = 0.85, tolerance: float = 1e-7) -> DataFrame:
    """(host, trust, distrust) from seeds (host, trust, distrust), each adding up to one, over links (src, dst, n).

    Scores are sums of positive terms, one for each number of links walked. Terms are added until none is above
    tolerance times the score of its host, so that each host that a seed reaches has a score, however far it is.
    """
    if links.isEmpty():
        return seeds
    forward = links.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(
        links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"),
    )
    out = forward.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    start = seeds.select(
        "host",
        F.explode(F.create_map(F.lit("trust"), "trust", F.lit("distrust"), "distrust")).alias("kind", "s"),
    ).where("s > 0")
    first = ((1 - damping) * F.col("s")).alias("r")
    now = cut(start.select("kind", "host", first, first.alias("d")))
    # A step of each host to itself, without a share, carries its score on, so that a round reads the scores once.
    stays = forward.select("kind", F.col("src").alias("host")).unionByName(
        forward.select("kind", F.col("dst").alias("host")),
    ).unionByName(now.select("kind", "host")).distinct()
    steps = cut(
        forward.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("total")).alias("p")).unionByName(
            stays.select("kind", F.col("host").alias("src"), F.col("host").alias("dst"), F.lit(None).cast("double").alias("p")),
        ),
    )
    while not now.where(F.col("d") > tolerance * F.col("r")).isEmpty():
        for _ in range(ROUNDS):
            moved = F.coalesce(damping * F.col("d") * F.col("p"), F.lit(0.0))
            kept = F.when(F.col("p").isNull(), F.col("r")).otherwise(0.0)
            both = now.withColumnRenamed("host", "src").join(steps, ["kind", "src"]).select(
                "kind",
                F.col("dst").alias("host"),
                (kept + moved).alias("r"),
                moved.alias("d"),
            )
            now = both.groupBy("kind", "host").agg(F.sum("r").alias("r"), F.sum("d").alias("d"))
        now = cut(now)
    score = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("r")).otherwise(0.0))
    return now.groupBy("host").agg(score("trust").alias("trust"), score("distrust").alias("distrust"))


def calibrated(judged: DataFrame, scores: DataFrame, powers: int = 8) -> float:
    """The power of two by which scores (host, trust, distrust) tell blocked from allowed pages of judged best."""
    ruled = judged.where("rule IS NOT NULL").groupBy("host").agg(
        F.count_if(F.col("verdict") == "block").alias("b"),
        F.count_if(F.col("verdict") == "allow").alias("a"),
    )
    tried = sorted((2.0**p for p in range(-powers, powers + 1)), key=lambda r: (max(r, 1 / r), r))
    scored = ruled.join(scores, "host").select(
        "a",
        "b",
        F.explode(
            F.array(
                *(
                    F.struct(
                        F.lit(i).alias("i"),
                        (F.col("distrust") > F.col("trust") * r * (1 + TIE)).alias("blocked"),
                    ) for i, r in enumerate(tried)
                ),
            ),
        ).alias("t"),
    )
    right = scored.groupBy("t.i").agg(
        F.coalesce(F.try_divide(F.sum(F.when(F.col("t.blocked"), F.col("b")).otherwise(0)), F.sum("b")), F.lit(0.0)).alias("caught"),
        F.coalesce(F.try_divide(F.sum(F.when(~F.col("t.blocked"), F.col("a")).otherwise(0)), F.sum("a")), F.lit(0.0)).alias("spared"))
    best = right.orderBy(F.desc(F.round(F.col("caught") + F.col("spared"), 9)), "i").limit(1).collect()  # one row for each ratio tried
    return tried[best[0]["i"]] if best else 1.0


def filter_urls(
    pages: DataFrame,
    rules: list[tuple[str, str]] | DataFrame,
    ratio: float | None = None,
    id_col: str = "page_id",
) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of every row of pages (page_id, url, html)."""
    host, path = host_and_path(F.col("url"))
    parsed = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), "html")
    urls = parsed.drop("html")
    if isinstance(rules, DataFrame):
        judged = join_rules(urls, rules)
    else:
        judged = urls.withColumn("__m", matching_rule(F.col("host"), F.col("path"), rules)).select(
            "page_id",
            "host",
            "path",
            "__m.rule",
            "__m.verdict",
        )
    counts = judged.where("rule IS NOT NULL").groupBy("host").agg(
        F.count_if(F.col("verdict") == "allow").alias("a"),
        F.count_if(F.col("verdict") == "block").alias("b"),
    )
    total = counts.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))  # one row
    seeds = counts.crossJoin(F.broadcast(total)).select(
        "host",
        F.coalesce(F.try_divide("a", "ta"), F.lit(0.0)).alias("trust"),
        F.coalesce(F.try_divide("b", "tb"), F.lit(0.0)).alias("distrust"),
    )
    links = host_links(parsed).unionByName(domain_links(parsed)).groupBy("src", "dst").agg(F.sum("n").alias("n"))
    walked = propagate(seeds, cut(links))
    whole = walked.agg(F.sum("trust").alias("st"), F.sum("distrust").alias("sd"))  # one row
    shares = {
        "trust": F.coalesce(F.try_divide("trust", "st"), F.lit(0.0)),
        "distrust": F.coalesce(F.try_divide("distrust", "sd"), F.lit(0.0)),
    }
    scores = cut(walked.crossJoin(F.broadcast(whole)).withColumns(shares).select("host", "trust", "distrust"))
    ratio = calibrated(judged, scores) if ratio is None else ratio
    joined = judged.join(scores, "host", "left")
    trust, distrust = (F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust"))
    verdict = F.coalesce("verdict", F.when(distrust > trust * ratio * (1 + TIE), "block").otherwise("allow"))
    return joined.select(
        "page_id",
        "host",
        "path",
        "rule",
        verdict.alias("verdict"),
        trust.alias("trust"),
        distrust.alias("distrust"),
    )
