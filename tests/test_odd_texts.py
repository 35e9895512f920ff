"""Queries against their SQL, over texts that a generator of prose doesn't make."""

import csv
import random
from pathlib import Path

import duckdb
import pytest

from pairlab import registry
from pairlab.sources import io

TEXTS = [
    "une rationé", "nationè, nation", "tion", "tion_", "tionſ", "tioń", "été actionß |", "ration", "", "plain", None,
    "é1.2.3.4", "1.2.3.4é", "٣1.2.3.4", "1.2.3.4", "_1.2.3.4", "CC BY tionê", "License tionç", "@mail1.example.com tion中", "@a.example 1.2.3.4ü tion",
    " a ", "\ta\n", " ", "\n", "\r", "a\rb", "a\r\nb", '"', '""', ' "a" ', '\0"b', "\0", "a,b", ",", "#a", "\ufeffa", "\\", '\\"', "\x01a\x1f", "null",
]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, ("en", "fr", None)[i % 3], f"src{i % 4}", len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path


QUERIES = [
    "d1_scan_rules",
    "d1_scan_rule_table",
    "d3_merge_findings",
    "d4_derive_flags",
    "d5_scan_incremental",
    "d7_category_distribution",
    "d8_co_occurrence",
    "d9_partition_ids",
    "s4_csv",
    "t1_scan_stream",
]


@pytest.mark.parametrize("name", QUERIES)
def test_query_of_odd_texts(spark, sf, name):
    got = registry.QUERIES[name](spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet/*.parquet'")
    cursor = con.execute(registry.ORACLE_SQL[name])
    want = got.select([d[0] for d in cursor.description])
    assert sorted(map(repr, map(tuple, want.collect()))) == sorted(map(repr, cursor.fetchall()))


def test_csv_keeps_every_text(spark, tmp_path):
    rng = random.Random(6)
    text = lambda: rng.choice(TEXTS) if rng.random() < 0.3 else "".join(rng.choice('"",\n\r \t\0\\ab#\ufeff\u2028é\x1a') for _ in range(rng.randrange(9)))
    rows = [(text(), i, text(), rng.choice([None, 0.5])) for i in range(4000)]
    df = spark.createDataFrame(rows, "t string, id long, u string, x double").repartition(3)
    io.write_csv(df, f"{tmp_path}/c")
    assert sorted(map(tuple, io.read_csv(spark, f"{tmp_path}/c", df.schema).collect()), key=lambda r: r[1]) == rows
    # Other readers find the same, but for null.
    plain = [r for f in Path(tmp_path, "c").glob("part-*") for r in list(csv.reader(open(f, newline="", encoding="utf-8")))[1:]]
    assert sorted(((t, int(i), u) for t, i, u, _ in plain), key=lambda r: r[1]) == [(t or "", i, u or "") for t, i, u, _ in rows]


def test_csv_of_one_column_keeps_its_rows(spark, tmp_path):
    texts = [" a", "", None, "b\n", None, ","]
    io.write_csv(spark.createDataFrame([(t,) for t in texts], "t string"), f"{tmp_path}/c")
    back = io.read_csv(spark, f"{tmp_path}/c", "t string")
    assert sorted(map(repr, (r.t for r in back.collect()))) == sorted(map(repr, texts)) and back.count() == 6
