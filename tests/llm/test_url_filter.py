import numpy as np
from pyspark.sql import functions as F

from pairlab.llm import url_filter as uf
from pairlab.llm.queries import URL_RULES

URLS = [
    ("http://www.Example.com/en/7x?y#z", "www.example.com", "/en/7x", "example.com/en/7", "allow"),
    ("https://a.com/en/7", "a.com", "/en/7", "com/en/", "block"),
    ("https://badexample.com/en/7", "badexample.com", "/en/7", "com/en/", "block"),
    ("http://x.example.net/de/81", "x.example.net", "/de/81", "example.net/de/8", "block"),
    ("http://x.example.net/de/18", "x.example.net", "/de/18", "net/de/", "allow"),
    ("http://com/en/?q", "com", "/en/", "com/en/", "block"),
    ("http://a.com?x=/en/", "a.com", "", None, None),
    ("HTTP://A.ORG/es/b://c", "a.org", "/es/b://c", "org/es/", "block"),
    ("no scheme/en/", "", "", None, "allow"),
    ("://", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
]


def test_rules(spark):
    pages = spark.createDataFrame([(i, u[0], None, "x") for i, u in enumerate(URLS)], "page_id long, url string, html string, verdict string")
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    for given in (URL_RULES, rules):
        got = sorted(uf.filter_urls(pages, given).collect())
        for r, (_, host, path, rule, verdict) in zip(got, URLS, strict=True):
            assert (r.host, r.path, r.rule) == (host, path, rule)
            assert verdict in (None, r.verdict)
    assert uf.filter_urls(pages.limit(0), URL_RULES).count() == 0


def test_propagation(spark):
    links = [("good", "x", 3), ("good", "y", 1), ("x", "y", 2), ("y", "bad", 1), ("z", "bad", 5), ("x", "bad", 1), ("w", "z", 1)]
    seeds = {"good": (1.0, 0.0), "bad": (0.0, 1.0)}
    nodes = {n for a, b, _ in links for n in (a, b)}

    def walk(edges, start):
        r = dict(start)
        for _ in range(10):
            nxt = {n: 0.15 * start.get(n, 0.0) for n in nodes}
            for a, b, n in edges:
                nxt[b] += 0.85 * r.get(a, 0.0) * n / sum(m for c, _, m in edges if c == a)
            r = nxt
        return r

    trust, distrust = walk(links, {"good": 1.0}), walk([(b, a, n) for a, b, n in links], {"bad": 1.0})
    df = spark.createDataFrame([(h, *v) for h, v in seeds.items()], "host string, trust double, distrust double")
    got = {r.host: (r.trust, r.distrust) for r in uf.propagate(df, spark.createDataFrame(links, "src string, dst string, n long")).collect()}
    for n in nodes:
        assert abs(got.get(n, (0, 0))[0] - trust[n]) < 1e-9 and abs(got.get(n, (0, 0))[1] - distrust[n]) < 1e-9


def test_small_and_far_scores(spark):
    # A chain of 16 links to a blocked host, and a host that one of 10**14 links into a blocked host comes from.
    chain = [(f"c{i}", f"c{i + 1}", 1) for i in range(15)] + [("c15", "bad", 1)]
    links = [*chain, ("tiny", "bad", 1), ("big", "bad", 10**14), ("loop", "big", 1), ("big", "loop", 1)]
    df = spark.createDataFrame([("bad", 0.0, 1.0)], "host string, trust double, distrust double")
    got = {r.host: r.distrust for r in uf.propagate(df, spark.createDataFrame(links, "src string, dst string, n long")).collect()}
    nodes = sorted({n for a, b, _ in links for n in (a, b)})
    at, steps = {n: i for i, n in enumerate(nodes)}, np.zeros((len(nodes), len(nodes)))
    for a, b, n in links:
        steps[at[b], at[a]] = n
    steps /= np.maximum(steps.sum(axis=1, keepdims=True), 1)
    exact = np.linalg.solve(np.eye(len(nodes)) - 0.85 * steps.T, 0.15 * np.eye(len(nodes))[at["bad"]])
    assert all(got[n] > 0 and abs(got[n] / exact[at[n]] - 1) < 1e-5 for n in nodes)


def test_verdicts_far_from_seeds(spark):
    page = lambda i, host, *to: (i, f"http://{host}/", "".join(f'<a href="http://{t}/">x</a>' for t in to))
    pages = [page(i, f"h{i}", f"h{i + 1}") for i in range(14)] + [page(14, "h14", "bad.com"), page(15, "bad.com"), page(16, "good.com")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for ratio in (1.0, None):
        got = {r.host: r.verdict for r in uf.filter_urls(df, [("bad.com", "block"), ("good.com", "allow")], ratio).collect()}
        assert got == {f"h{i}": "block" for i in range(15)} | {"bad.com": "block", "good.com": "allow"}


def test_domains_share_what_is_known(spark):
    urls = ["http://a.site.com/bad/1", "http://a.site.com/bad/2", "http://b.site.com/x", "http://deep.b.site.com/y", "http://ok.org/good/1", "http://www.ok.org/z", "http://other.net/"]
    pages = spark.createDataFrame([(i, u, '<a href="/x">x</a>') for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: r for r in uf.filter_urls(pages, [("com/bad/", "block"), ("org/good/", "allow")]).collect()}
    assert [got[i].verdict for i in range(7)] == ["block", "block", "block", "block", "allow", "allow", "allow"]
    assert got[2].distrust > 0 == got[2].trust and got[5].trust > 0 == got[5].distrust and got[6].trust == got[6].distrust == 0
    links = {(r.src, r.dst): r.n for r in uf.domain_links(spark.createDataFrame([("deep.b.site.com",), ("b.site.com",), ("com",), ("",), ("..",), ("x.y",)], "host string")).select("src", "dst", F.col("n")).collect()}
    assert links[("b.site.com", "site.com")] == 2 and links[("site.com", "b.site.com")] == 2 and links[("deep.b.site.com", "b.site.com")] == 1
    assert not any("com" in pair or "" in pair for pair in links)


def test_ratio_is_calibrated(spark):
    judged = spark.createDataFrame([("a", "r", "block")] * 3 + [("b", "r", "allow")] * 2 + [("c", None, None)], "host string, rule string, verdict string")
    scores = spark.createDataFrame([("a", 0.5, 0.3), ("b", 0.5, 0.1)], "host string, trust double, distrust double")
    assert uf.calibrated(judged, scores) == 0.5  # 0.3 of 0.5 is blocked, 0.1 of 0.5 is not
    assert uf.calibrated(judged.where("rule IS NULL"), scores) == 1.0


def test_long_urls_and_broken_html(spark):
    rows = [(1, "http://a.com/" + "x" * 200_000, "<a " * 20_000), (2, "http://" + "h" * 100_000, "<a href=" + "'" * 50_000), (3, "http://b.com", '<a\nhref = "http://c.com">')]
    got = {r.page_id: r for r in uf.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), [("com/", "block")]).collect()}
    assert len(got[1].path) == 200_001 and len(got[2].host) == 100_000 and got[3].verdict == "allow" and got[3].path == ""


def test_links(spark):
    html = '<a href="http://B.org/x">1</a><a class=c href=\'//c.net?q\'>2</a><a href=/rel>3</a><a href="http://b.org">4</a><a href=http://a.com/self>5</a>'
    pages = spark.createDataFrame([("a.com", html), ("", html), ("d.com", None)], "host string, html string")
    got = {(r.src, r.dst): r.n for r in uf.host_links(pages).select("src", "dst", F.col("n")).collect()}
    assert got == {("a.com", "b.org"): 2, ("a.com", "c.net"): 1}
