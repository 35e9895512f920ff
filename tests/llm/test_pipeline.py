import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: "w%d" % rng.randrange(3000)
    text = lambda n: "\n".join(" ".join(word() for _ in range(12)) for _ in range(n))
    base, passage = text(6), " ".join(word() for _ in range(60))
    docs = [(i, text(6), "en", "s", 1) for i in range(20)]
    docs += [(30, base, "en", "s", 1), (31, text(3) + "\n" + passage, "en", "s", 1), (32, passage + " " + text(4), "en", "s", 1), (33, "too short", "en", "s", 1), (34, None, None, None, None), (None, text(5), "en", "s", 1)]
    mixed = base.replace("\n", " ")
    docs += [(35, mixed, "en", "s", 1), (36, docs[3][1] + "\n" + text(5), "en", "s", 1)]
    sf = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    now = spark.read.parquet(f"{sf}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, now, sf).write.parquet(f"{sf}/{name}")
        now = spark.read.parquet(f"{sf}/{name}")
        assert now.columns == corpus_pipeline.COLUMNS
        seen.append({r.doc_id: r.text for r in now.collect()})
    good, lines, first, passages = seen
    assert set(good) == {d[0] for d in docs} - {33, 34}
    assert docs[3][1] not in lines[36] and len(lines[36].split("\n")) == 5 and lines[3] == docs[3][1]
    assert 35 not in first and 30 in first and set(first) == set(good) - {35}
    assert passage in passages[31] and passage not in passages[32]
    pieces = corpus_pipeline.run(spark, sf).collect()
    assert {p.doc_id for p in pieces} == set(passages)
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())


def test_whole_pipeline_against_plain_python(spark, tmp_path):
    """Every stage against a brute-force version on the stage's own input, with labels, so that the forest decides too."""
    import pandas as pd
    import public_tokenizers
    import test_line_dedup
    import test_minhash
    import test_quality
    import test_suffix
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    given = {r.doc_id: r.text for r in docs.collect()}
    quality_of = pd.read_parquet(f"{sf}/labels.parquet").set_index("doc_id")["quality"].to_dict()
    now, texts = docs, [given]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, now, sf).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        texts.append({r.doc_id: r.text for r in now.collect()})
        assert now.count() == len(texts[-1])
    good, lines, first, passages = texts[1:]
    rules = {d for d, t in given.items() if not test_quality.brute(t)[5]}
    assert set(good) <= rules and all(good[d] == given[d] for d in good)
    sound = [d for d in rules if quality_of.get(d) == 1]
    assert sum(d in good for d in sound) >= 0.98 * len(sound)
    assert lines == {d: v[0] for d, v in test_line_dedup.brute(list(good.items())).items()}
    sets = [(d, test_minhash.shingles(t)) for d, t in lines.items()]
    links = [(a, b) for i, (a, s) in enumerate(sets) for b, t in sets[:i] if s and t and 100 * len(s & t) >= 80 * len(s | t)]
    root = test_minhash.components(list(lines), links)
    blank = {}
    for d, s in sets:
        if not s:
            blank.setdefault((d, lines[d]), d)
    assert first == {d: t for d, t in lines.items() if root[d] == d}
    kept = test_suffix.kept(list(first.items()))
    assert passages == {d: b.decode("utf-8", "replace") for d, b in kept.items()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    pieces = corpus_pipeline.run(spark, sf).collect()
    sizes = {d: len(library.encode(t, add_special_tokens=False).ids) + 1 for d, t in passages.items()}
    assert {p.doc_id: p.doc_tokens for p in pieces} == sizes and sum(p.length for p in pieces) == sum(sizes.values())


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_ids_are_judged_by_row(spark):
    rng = random.Random(5)
    text = lambda: " ".join("w%d" % rng.randrange(3000) for _ in range(60))
    a, b, c, d = (text() for _ in range(4))
    rows = [(1, a), (2, b), (2, a), (2, c), (3, c), (4, d), (4, d), (5, ""), (5, ""), (5, None), (6, ""), (None, a), (None, a)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.keep_first(spark, df, "").collect()]
    assert sorted(got, key=str) == sorted([(1, a), (2, b), (2, c), (4, d), (5, ""), (5, None), (6, ""), (None, a), (None, a)], key=str)
