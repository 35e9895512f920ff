"""The registered queries on the smallest tables, against plain Python and the tokenizers library."""

import hashlib
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
import test_line_dedup
import test_minhash
import test_quality
import test_suffix
from tokenizers import Tokenizer

from pairlab.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    df = pd.read_parquet(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    return list(zip(df["doc_id"].tolist(), df["text"].tolist(), strict=True))


@pytest.fixture(scope="module")
def ids(docs):
    library = Tokenizer.from_file(queries.BYTE_BPE)
    library.no_truncation()
    library.no_padding()
    return {d: library.encode(t or "", add_special_tokens=False).ids for d, t in docs}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_sql(spark, name, folder):
    sf = f"/root/testdata/{folder}"
    db = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cursor = db.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    df = queries.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(tuple, df.select(*columns).collect()), key=str) == sorted(cursor.fetchall(), key=str)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crc(values):
    return zlib.crc32(b"".join(x.to_bytes(4, "little") for x in values))


def rows(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def test_op1(spark, docs, ids):
    want = {d: (len(ids[d]), sha(",".join(map(str, ids[d]))), sha(t)) for d, t in docs}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows(spark, "op1_bpe_round_trip")} == want


def test_op2(spark):
    pages = pd.read_parquet(f"{SF}/pages.parquet", columns=["page_id", "url"])
    got = {r.page_id: r for r in rows(spark, "op2_url_filter")}
    seeds = {"allow": {}, "block": {}}
    parsed = {}
    for page, url in zip(pages["page_id"].tolist(), pages["url"], strict=True):
        rest = url.partition("://")[2]
        end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
        host, tail = rest[:end].lower(), rest[end:]
        path = tail[: min([i for i in map(tail.find, "?#") if i >= 0], default=len(tail))]
        fits = [(len(r), r, v) for r, v in queries.URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        parsed[page] = (host, path, *(max(fits)[1:] if fits else (None, None)))
        if fits:
            seeds[max(fits)[2]][host] = seeds[max(fits)[2]].get(host, 0) + 1
    # Every href is relative here, so hosts are linked with the domains above them only.
    edges = {}
    for host, *_ in parsed.values():
        parts = host.split(".")
        for i in range(len(parts) - 2):
            for pair in ((".".join(parts[i:]), ".".join(parts[i + 1 :])), (".".join(parts[i + 1 :]), ".".join(parts[i:]))):
                edges[pair] = edges.get(pair, 0) + 1
    nodes = sorted({n for pair in edges for n in pair} | {h for s in seeds.values() for h in s})
    at = {n: i for i, n in enumerate(nodes)}
    steps = np.zeros((len(nodes), len(nodes)))
    for (a, b), n in edges.items():
        steps[at[b], at[a]] = n
    share = {}
    for v, towards in (("allow", steps), ("block", steps.T.copy())):
        walk = towards / np.maximum(towards.sum(axis=0, keepdims=True), 1)
        start = np.array([seeds[v].get(n, 0) for n in nodes]) / sum(seeds[v].values())
        x = np.linalg.solve(np.eye(len(nodes)) - 0.85 * walk, 0.15 * start)
        share[v] = dict(zip(nodes, x / x.sum(), strict=True))
    blocked = lambda h, ratio: share["block"].get(h, 0) > share["allow"].get(h, 0) * ratio * (1 + 1e-6)
    part = lambda v, ratio: sum(n for h, n in seeds[v].items() if blocked(h, ratio) == (v == "block")) / sum(seeds[v].values())
    ratio = max(sorted((2.0**p for p in range(-8, 9)), key=lambda r: (max(r, 1 / r), r)), key=lambda r: round(part("allow", r) + part("block", r), 9))
    walked = 0
    for page, (host, path, rule, verdict) in parsed.items():
        verdict = verdict or ("block" if blocked(host, ratio) else "allow")
        assert (got[page].host, got[page].path, got[page].rule, got[page].verdict) == (host, path, rule, verdict)
        own = share["allow"].get(host, 0) + share["block"].get(host, 0)
        walked += rule is None and own > 0 and host not in seeds["allow"] and host not in seeds["block"]
    assert walked > 0  # hosts without a seed of their own have scores


def test_op3(spark, ids):
    by_sequence, by_doc = {}, {}
    for r in rows(spark, "op3_pack_sequences"):
        own = [*ids[r.doc_id], 0][r.start : r.start + r.length]
        assert (r.length, r.ids_crc32, r.doc_tokens) == (len(own), crc(own), len(ids[r.doc_id]) + 1)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc[r.doc_id] = by_doc.get(r.doc_id, 0) + r.length
    assert by_doc == {d: len(x) + 1 for d, x in ids.items()}
    for parts in by_sequence.values():
        assert all(o == sum(n for _, n in sorted(parts)[:i]) for i, (o, _) in enumerate(sorted(parts))) and sum(n for _, n in parts) <= 1024
    assert sum(by_doc.values()) > 0.95 * 1024 * len(by_sequence)


def test_op4(spark, docs):
    got = {r.doc_id: (*r[1:7], r.kept) for r in rows(spark, "op4_quality_rules")}
    labels = pd.read_parquet(f"{SF}/labels.parquet").set_index("doc_id")["quality"].to_dict()
    for d, t in docs:
        assert got[d][:6] == test_quality.brute(t) and not (got[d][5] and got[d][6])
    judged = [(labels[d], got[d][6]) for d, _ in docs if d in labels and not got[d][5]]
    assert sum(k for q, k in judged if q) >= 0.98 * sum(q for q, _ in judged)


def test_op6(spark, docs):
    want = {d: (n, gone, sha(text)) for d, (text, n, gone) in test_line_dedup.brute(docs).items()}
    assert {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in rows(spark, "op6_line_dedup")} == want


def test_op7(spark, docs):
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows(spark, "op7_suffix_repeats")), key=str)
    assert got == test_suffix.brute(docs)


def test_op8(spark, ids):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rows(spark, "op8_token_files")}
    at = 0
    for d in sorted(ids):
        assert got[d] == (at, len(ids[d]) + 1, crc([*ids[d], 0]))
        at += len(ids[d]) + 1


def test_op9(spark, docs):
    sets = [(d, test_minhash.shingles(t)) for d, t in docs]
    links = [(a, b) for i, (a, s) in enumerate(sets) for b, t in sets[:i] if s and t and 100 * len(s & t) >= 85 * len(s | t)]
    want = test_minhash.components([d for d, _ in sets], links)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows(spark, "op9_minhash_near_duplicates")} == {d: (len(s), want[d], want[d] == d) for d, s in sets}


def test_op10(spark, docs):
    order = sorted(docs, reverse=True)
    following = {d: n for (d, _), (_, n) in zip(order, order[1:] + order[:1], strict=True)}
    near = lambda s, t: len(s & t) / len(s | t) if s | t else 1.0
    low = lambda t: test_minhash.shingles(t.lower())
    prints = {}
    for r in rows(spark, "op10_fingerprints"):
        text = dict(docs)[r.doc_id]
        n = len(text)
        edited = text[: n - n // 3] + following[r.doc_id][: n // 3]
        assert (r.n_chars, r.edited_sha256) == (n, sha(edited))
        assert abs(r.near_edited - near(low(text), low(edited))) < 0.2 and abs(r.near_next - near(low(text), low(following[r.doc_id]))) < 0.2
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
    assert len(set(prints.values())) >= 0.95 * len(prints)
