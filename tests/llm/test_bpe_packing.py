import random
import time
import zlib

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairlab.llm import bpe, packing, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def texts():
    rng = random.Random(1)
    bits = ["the", " ", "  ", "\n", "été", "don't", "I'LL", "123", "<|endoftext|>", "😀", "aaaa", "=-=-", "\x00", "ß", "日本", "\x1c", "\xa0", "w"]
    return [None, "", "a" * 3000, " " * 500 + "x", *("".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randrange(0, 400))) for _ in range(80))]


def frame(spark):
    return spark.createDataFrame([(i % 70, t, 7) for i, t in enumerate(texts())], "doc_id long, text string, ids int").repartition(3)


def test_encode_decode(spark):
    library = Tokenizer.from_file(PATH)
    want = sorted((i % 70, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in enumerate(texts()))
    encoded = bpe.encode_documents(frame(spark), PATH)
    assert sorted((r.doc_id, list(r.ids), r.decoded) for r in bpe.decode_documents(encoded, PATH).collect()) == want
    assert bpe.encode_documents(frame(spark).limit(0), PATH).count() == 0
    odd = spark.createDataFrame([(1, [200, 201, 5]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in bpe.decode_documents(odd, PATH).collect()} == {1: library.decode([200, 201, 5], skip_special_tokens=False), 2: "", 3: ""}


def test_fast_ids():
    library = Tokenizer.from_file(PATH)
    for t in texts():
        assert tokens.encoder(PATH).encode(t or "").tolist() == library.encode(t or "", add_special_tokens=False).ids


def test_packing(spark):
    library = Tokenizer.from_file(PATH)
    data = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id long, text string").repartition(3)
    pieces = packing.pack_documents(data, PATH, window=64, with_ids=True)
    rows = pieces.collect()
    by_doc, by_sequence = {}, {}
    for p in rows:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
        assert p.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in p.ids)) and p.length == len(p.ids)
    for i, t in enumerate(texts()):
        ids = [x for p in sorted(by_doc[i], key=lambda p: p.start) for x in p.ids]
        assert ids == [*library.encode(t or "", add_special_tokens=False).ids, 0] and {p.doc_tokens for p in by_doc[i]} == {len(ids)}
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 64
    padded = packing.padded_sequences(pieces, window=64).select("sequence_id", F.size("input_ids").alias("n"), "n_tokens").collect()
    assert all(r.n == (r.n_tokens if r.n_tokens & (r.n_tokens - 1) == 0 else 64) for r in padded) and len(padded) == len(by_sequence)
    assert packing.pack_documents(data.limit(0), PATH).count() == 0


def test_best_fit():
    rng = random.Random(3)
    lengths = [rng.randrange(1, 65) for _ in range(500)]
    placed = packing.best_fit_decreasing(lengths, 64)
    # By plain search: the tightest window that holds each length, longest first.
    room, want = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [c for c in room if c >= lengths[i]]
        if fits:
            room.remove(min(fits))
        want[i] = min(fits) if fits else 64
        room.append(want[i] - lengths[i])
    assert all(64 - placed[i][1] == want[i] for i in want)


def test_long_runs_are_found_as_the_pattern_finds_them():
    rng = random.Random(4)
    some = [" " * n + "x" * m + w * k + "y" for n in (0, 1, 398, 399, 400, 401) for m in (0, 1, 399, 400) for w in (" ", "\n", "\x1c", "\xa0", "1", "-", "​") for k in (0, 1, 398, 399, 400)]
    some += ["".join(rng.choice(["a" * 200, " " * 200, "\t", "b ", "é" * 199, "7" * 200]) for _ in range(rng.randrange(6))) for _ in range(2000)]
    found = [tokens.has_long_run(t) for t in some]
    assert found == [tokens.LONG_RUN.search(t) is not None for t in some] and 100 < sum(found) < len(found) - 100


def test_looking_for_long_runs_takes_little_time():
    """The search for long runs once took longer than the encoding itself."""
    rng = random.Random(5)
    text = " ".join("".join(rng.choice(["th", "an", "re", "ou", "in"]) for _ in range(rng.randrange(1, 5))) for _ in range(100_000))
    own = tokens.encoder(PATH)
    assert not tokens.has_long_run(text)

    def least(f):
        seconds = []
        for _ in range(5):
            began = time.process_time()
            f()
            seconds.append(time.process_time() - began)
        return min(seconds)

    assert least(lambda: own.encode(text)) < 1.6 * least(lambda: own.fast.encode_to_numpy(text, allowed_special="all"))
