"""Near-duplicate documents by MinHash.

Each document's set of word shingles gives a signature of universal-hash minima. Documents of equal sets form a class,
of which the least id goes on. Bands of the signatures deal the classes into buckets; pairs are first
compared by signature, then confirmed on their full sets, and confirmed links become components by alternating
large-star and small-star steps.

Buckets may be large and overlap, so their pairs are not made. Classes that share buckets, directly or through others,
form loose groups, each class in one of them; its full set is sent there once. A task compares the documents of a group
and gives just enough confirmed links to join all that belong together; pairs joined already are not looked at. A group
beyond ``BLOCK`` documents is compared block with block, so that none is left out and no task holds more than two
blocks.

Words are what lies between space and the control characters 0x09 to 0x0D, with A-Z lower-cased. A document with fewer
words than a shingle has one shingle of all of them. Defined cases: a null or blank text has no shingles and is linked
with nothing; a row with a null id takes no part, has a null component and is kept; rows that repeat an id are one node,
of which each row's text counts; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.llm.common import cut
from pairlab.llm.components import connected_components

U = np.uint64
#: Bands and minima in each: at a similarity of 0.85 a pair shares no band with a probability of 4e-7, at 0.8 of 4e-5.
BANDS, ROWS = 25, 5
#: Documents of a group that are compared at a time.
BLOCK = 1000


def scrambled(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: The universal hashes x -> (a * x + b) mod 2**64, of which the upper 32 bits count.
_a = scrambled(np.arange(1, BANDS * ROWS + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
_b = scrambled(_a + U(77))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < 300_000:
            self[word] = value
        return value


KNOWN = WordHashes()


def shingle_set(text: bytes, words: int = 5) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, U)
    h = np.fromiter(map(KNOWN.__getitem__, found), U, len(found))
    size = min(words, len(h))
    out = np.full(len(h) - size + 1, size, U)
    for i in range(size):
        out = scrambled(out * U(0xD6E8FEB86659FD93) + h[i : len(h) - size + 1 + i])
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The upper halves of the least universal hashes."""
    least = np.full(BANDS * ROWS, 2**64 - 1, U)
    for i in range(0, len(shingles), 512):
        least = np.minimum(least, (_a[:, None] * shingles[None, i : i + 512] + _b[:, None]).min(axis=1))
    return (least >> U(32)).astype("<u4")


def signatures(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, n_shingles, set_key (a 128-bit digest of the set; null for an empty set) and signature of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, minima = [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py() or b"", words)
                sizes.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                minima.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array(minima, pa.binary()),
                ],
                names=["doc_id", "n_shingles", "set_key", "signature"],
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, signature binary")


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                sets = [shingle_set(t.as_py() or b"", words).tobytes() for t in part.column(1)]
                keys = [hashlib.blake2b(s, digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(keys, pa.binary()), pa.array(sets, pa.binary())],
                    names=["rep", "set_key", "shingles"],
                )

    return run


def confirmed_links(
    reps: np.ndarray,
    block: np.ndarray,
    minima: np.ndarray,
    sets: list[np.ndarray],
    percent: int,
) -> list[tuple[int, int]]:
    """Links among documents, enough of them to join all that are alike; with two blocks, those between the blocks.

    A pair that is joined already is not looked at. Others are compared by signature and then on their full sets, one
    document with all its candidates at a time.
    """
    share = percent / 100
    # Five standard deviations of the signature's estimate below the threshold.
    least = (share - 5 * (share * (1 - share) / minima.shape[1]) ** 0.5) * minima.shape[1]
    lengths = np.fromiter(map(len, sets), np.int64, len(sets))
    ends = np.cumsum(lengths)
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    present = np.zeros(len(codes), bool)
    cross = block.min() != block.max()
    _, label = np.unique(reps, return_inverse=True)
    links = []
    for x in range(len(sets) - 1):
        near = label[x + 1 :] != label[x]
        if cross:
            near &= block[x + 1 :] != block[x]
        near = x + 1 + np.flatnonzero(near)
        near = near[(minima[near] == minima[x]).sum(axis=1) >= least]
        if not len(near):
            continue
        own = codes[ends[x] - lengths[x] : ends[x]]
        present[own] = True
        if len(near) < 32:
            both = np.array([present[codes[ends[y] - lengths[y] : ends[y]]].sum() for y in near])
        else:
            hits = np.concatenate([[0], np.cumsum(present[codes[ends[x] :]])])
            both = hits[ends[near] - ends[x]] - hits[ends[near] - lengths[near] - ends[x]]
        present[own] = False
        for y in near[100 * both >= percent * (lengths[x] + lengths[near] - both)].tolist():
            if label[y] != label[x]:
                links.append((int(reps[x]), int(reps[y])))
                label[label == label[y]] = label[x]
    return links


def _confirmed(percent: int):
    """Links from rows (group, i, j, own, rep, signature, shingles) in order of their groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group = None
        found: list[tuple[int, int]] = []

        def close() -> None:
            if len(held) > 1:
                minima = np.frombuffer(b"".join(r[2] for r in held), "<u4").reshape(len(held), -1)
                sets = [np.frombuffer(r[3], U) for r in held]
                found.extend(
                    confirmed_links(
                        np.array([r[1] for r in held]),
                        np.array([r[0] for r in held]),
                        minima,
                        sets,
                        percent,
                    ),
                )
            held.clear()

        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                columns = [c.to_pylist() for c in batch.slice(i, 1000).columns]
                for *key, own, rep, minima, shingles in zip(*columns, strict=True):
                    if key != group:
                        close()
                        group = key
                    held.append((own, rep, minima, shingles))
                links = np.array(found, np.int64).reshape(-1, 2)
                found = []
                yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])
        close()
        links = np.array(found, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])

    return run


def near_duplicates(
    df: DataFrame,
    percent: int = 85,
    words: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each row of df: doc_id, n_shingles, component_id and kept.

    Documents are linked when 100 * intersection >= percent * union of their shingle sets.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("__text"))
    rows = cut(signatures(docs, words))
    known = rows.where("doc_id IS NOT NULL AND set_key IS NOT NULL")
    classes = cut(known.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature")))
    bands = F.explode(
        F.transform(
            F.sequence(F.lit(0), F.lit(BANDS - 1)),
            lambda i: F.xxhash64(i, F.substring(F.col("signature"), i * 4 * ROWS + 1, F.lit(4 * ROWS))),
        ),
    )
    spread = classes.select("rep", bands.alias("bucket"))
    leaders = spread.groupBy("bucket").agg(
        F.min("rep").alias("leader"),
        F.max("rep").alias("other"),
    ).where("leader < other")
    loose = connected_components(
        cut(spread.join(leaders, "bucket").select("rep", "leader").where("rep != leader").distinct()),
        "rep",
        "leader",
    )
    loose = cut(loose)
    # Groups beyond BLOCK are compared block by block.
    parts = loose.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    dealt = loose.join(parts, "component").select(
        "component",
        F.col("node").alias("rep"),
        "parts",
    ).withColumn("own", own)
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda x: F.struct(F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j")),
    )
    texts = docs.where("doc_id IS NOT NULL").join(loose.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    sets = texts.mapInArrow(
        _sets(words),
        "rep long, set_key binary, shingles binary",
    ).join(classes, ["rep", "set_key"]).dropDuplicates(["rep", "set_key"])
    work = sets.join(dealt, "rep").withColumn("p", F.explode(pairs)).select(
        "component",
        "p.i",
        "p.j",
        "own",
        "rep",
        "signature",
        "shingles",
    )
    keys = ["component", "i", "j"]
    confirmed = cut(
        work.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_confirmed(percent), "a long, b long"),
    )
    # Rows that repeat an id join the classes of all their texts.
    same = known.join(classes.select("set_key", "rep"), "set_key").where("doc_id != rep").select(
        F.col("doc_id").alias("a"),
        F.col("rep").alias("b"),
    ).distinct()
    joined = connected_components(same.unionByName(confirmed))
    result = rows.join(joined, rows.doc_id == joined.node, "left")
    component = F.coalesce("component", "doc_id")
    return result.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )
