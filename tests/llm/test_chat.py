import hashlib
import random

from pyspark.sql import functions as F

from pairlab.llm import chat

COLUMNS = "conv_id long, turn long, message_no long, role string, text string"


def test_round_trip(spark):
    rng = random.Random(6)
    bits = ["<|im_end|>", "<|im_start|>", "\n", "\\", "<", "|", "<\\|", "a", "é😀", "assistant\n", "$1", " "]
    rows = [(c, t, 1, rng.choice(["user", "assistant", "a\nb\\", "sys<|tem", ""]), "".join(rng.choice(bits) for _ in range(rng.randrange(0, 9)))) for c in range(30) for t in rng.sample(range(2000), rng.randrange(1, 30))]
    rows += [(99, 1, 1, None, None), (98, 1, 1, "assistant", ""), (97, None, 1, "assistant", "x"), (97, 3, 1, "user", "y"), (None, 0, 1, "assistant", "n"), (96, 1, 1, "assistant", "same"), (96, 1, 1, "assistant", "same")]
    out = chat.render(spark.createDataFrame(rows, COLUMNS))
    got = out.select("conv_id", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    want = {}
    for c, t, _, role, text in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1], r[3] or "", r[4] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in got} == want
    assert {r.conv_id: r.loss for r in got} == {c: "".join(x for role, x in v if role == "assistant") for c, v in want.items()}
    assert chat.render(spark.createDataFrame([], COLUMNS)).count() == 0


def by_hand(rows):
    """(conv, turn, role, text) by going through each conversation's events in order."""
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[3] or "", r[4] or "message", r[5] or ""))
        messages, at = [], {}
        for i, (_, seq, _, role, kind, _) in enumerate(own):
            if i == 0 or (kind or "message") == "message":
                messages.append([role or "", ""])
                if (kind or "message") == "message":
                    at.setdefault(seq, len(messages) - 1)
            own[i] = (*own[i], len(messages) - 1)
        for _, _, target, _, kind, text, now in own:
            m = messages[at.get(target, now) if kind not in (None, "message") and target is not None else now]
            m[1] = m[1] + (text or "") if kind == "delta" else (text or "")
        out += [(conv, i, *m) for i, m in enumerate(messages)]
    return sorted(out, key=str)


LOG = "conv_id long, seq long, target long, role string, kind string, text string"


def folded(df):
    return sorted(((r.conv_id, r.turn, r.role, r.text) for r in chat.fold_events(df).collect()), key=str)


def test_fold(spark):
    rows = [
        (1, 5, None, "user", "message", "hi"), (1, 6, None, None, "edit", "hello"), (1, 7, None, "assistant", "message", "A"), (1, 9, None, None, "delta", "B"), (1, 8, None, None, "delta", "C"),
        (1, 20, None, None, "regenerate", ""), (1, 21, None, None, "delta", "new "), (1, 22, None, None, "delta", "text"), (1, 30, None, "user", "message", "more"), (1, 40, 5, None, "edit", "late"), (1, 41, 5, "x", "delta", "r"), (1, 42, 99, None, "delta", "!"),
        (2, 1, None, "user", "delta", "only"), (2, 2, None, "user", None, "next"), (3, 1, None, "user", "message", "x"), (3, 1, None, "user", "message", "x"), (None, None, None, None, None, None),
    ]
    got = folded(spark.createDataFrame(rows, LOG))
    want = [(1, 0, "user", "later"), (1, 1, "assistant", "new text"), (1, 2, "user", "more!"), (2, 0, "user", "only"), (2, 1, "user", "next"), (3, 0, "user", "x"), (3, 1, "user", "x"), (None, 0, "", "")]
    assert got == sorted(want, key=str) == by_hand(rows)
    # A log needs no targets.
    assert len(folded(spark.createDataFrame(rows, LOG).drop("target"))) == 8
    assert chat.fold_events(spark.createDataFrame([], LOG)).collect() == []


def test_long_logs_are_folded_in_chunks(spark):
    """A conversation of 5,000 events, whose messages run on over chunks and are edited much later."""
    rng = random.Random(8)
    rows, begun = [], []
    for i in range(5000):
        seq = i * 3 + rng.randrange(3)
        kind = "message" if rng.random() < 0.01 else rng.choice(["delta", "delta", "delta", "edit", "regenerate"])
        target = rng.choice(begun) if begun and kind != "message" and rng.random() < 0.3 else None
        begun += [seq] if kind == "message" else []
        rows.append((7, seq, target, rng.choice(["user", "assistant"]), kind, f"{i} "))
    rows += [(8, 1, None, "user", "message", "short")]
    df = spark.createDataFrame(rows, LOG).repartition(5)
    assert folded(df) == by_hand(rows)


def test_logs_need_folding(spark):
    from pairlab.llm import queries

    rows = [(c, t, "assistant", "x" * (c % 5) + f" text {t}") for c in range(20) for t in range(6)] + [(7, 1, "assistant", "other"), (7, 1, "assistant", "other"), (None, None, None, None), (3, 0, "user", ""), (5, None, "user", "none"), (5, -(2**63), "user", "low"), (5, 2**63 - 1, "user", "high")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    events = queries.turn_events(df)
    assert {r.kind for r in events.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    assert events.where("target IS NOT NULL").count() > 5 and "turn" not in events.columns
    back = {}
    for r in sorted(chat.fold_events(events).collect(), key=lambda r: r.turn):
        back.setdefault(r.conv_id, []).append((r.role, r.text))
    want = {}
    for c, _, r, x in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    assert back == want
    # Without the fold a log's first texts are not the turns.
    assert events.where("kind = 'message'").join(df, ["conv_id", "text"], "left_semi").count() < len(rows) / 2


def test_clashing_columns_and_long_turns(spark):
    df = spark.createDataFrame([(1, 0, 1, "user", "x" * 3_000_000 + "<|im_end|>", "odd", "odd"), (1, 1, 1, "assistant", "y", "odd", "odd")], "conv_id long, turn long, message_no long, role string, text string, piece string, start string")
    r = chat.render(df).select(chat.read_back(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("l")).first()
    assert len(r.t[0].text) == 3_000_010 and r.l == "y"


def test_query_matches_sql(spark):
    import duckdb

    from pairlab.llm import queries

    sf = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in queries.op5_chat_format(spark, sf).collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    assert got == sorted(db.execute(queries.OP5_SQL).fetchall())
    assert any(r[0] == -1 and r[1] == 2 and r[4] == hashlib.sha256(queries.CONTROL_TEXT.encode()).hexdigest() for r in got)
