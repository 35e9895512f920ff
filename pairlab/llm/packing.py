"""Packing of tokenised documents into windows, by best-fit decreasing.

``pack_documents`` gives one row per piece of a document. Documents longer than a window are first cut into full
windows, each a sequence of its own; what is left of each document is placed, longest first, in the tightest open
window that holds it. A segment tree indexed by remaining capacity finds that window in log(window) steps.

Each task packs the documents of its own partition, which it may hold only as (document, start, length) records, so
nothing is shuffled and memory follows the partition. A partition leaves some windows part filled, as any packing does
at its end. sequence_id is partition * 2**32 + the window's number in it, so it is the same when a task is run again.

Defined cases: a null text is an empty one, whose only id is the end id; repeated rows are packed each for itself;
extra columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.llm.tokens import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class CapacityTree:
    """Open windows by remaining capacity: a segment tree over 0..size, each leaf a stack of windows."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.count = [0] * (2 * self.width)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def _change(self, capacity: int, by: int) -> None:
        at = self.width + capacity
        while at:
            self.count[at] += by
            at >>= 1

    def add(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        self._change(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove the window with the least capacity of at least need; give (capacity, window)."""
        at, count = self.width + need, self.count
        if not count[at]:
            # Climb until a subtree to the right has an open window, then go down to its leftmost leaf.
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.width:
                at = 2 * at if count[2 * at] else 2 * at + 1
        capacity = at - self.width
        window = self.open[capacity].pop()
        self._change(capacity, -1)
        return capacity, window


def best_fit_decreasing(lengths: list[int], size: int) -> list[tuple[int, int]]:
    """The (window, offset) of each length; windows are numbered from 0."""
    tree, placed, windows = CapacityTree(size), [(0, 0)] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if (found := tree.take(lengths[i])) is None:
            found = (size, windows)
            windows += 1
        capacity, window = found
        placed[i] = (window, size - capacity)
        if capacity > lengths[i]:
            tree.add(capacity - lengths[i], window)
    return placed


def pack_documents(
    df: DataFrame, path: str, window: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    schema = PIECES + (", ids array<int>" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        base = TaskContext.get().partitionId() << 32
        rest: list[tuple] = []
        sequences = 0

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
            return pa.RecordBatch.from_arrays(
                [*arrays, *(pa.array(c, pa.list_(pa.int32())) for c in columns[7:])],
                names=names,
            )

        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                total = len(ids)
                for start in range(0, total, window):
                    part = ids[start : start + window]
                    piece = (doc, start, len(part), zlib.crc32(part.tobytes()), total)
                    own = (part.astype(np.int32),) if with_ids else ()
                    if len(part) == window:
                        rows.append((*piece, base + sequences, 0, *own))
                        sequences += 1
                    else:
                        rest.append((piece, own))
            yield out(rows)
        placed = best_fit_decreasing([p[2] for p, _ in rest], window)
        for i in range(0, len(rest), 20_000):
            yield out(
                [
                    (*p, base + sequences + w, offset, *own) for (p, own), (w, offset) in zip(
                        rest[i : i + 20_000],
                        placed[i : i + 20_000],
                        strict=True,
                    )
                ],
            )

    return df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).alias("text"),
    ).mapInArrow(run, schema)


def padded_sequences(pieces: DataFrame, window: int = 1024, pad_id: int = 0) -> DataFrame:
    """The sequences of pieces made with_ids: sequence_id, input_ids, n_tokens and the pieces' documents.

    Sequences are padded to window, except those whose length is a power of two. A sequence has at most window pieces.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "ids")))
    ids, n = F.flatten(F.col("parts.ids")), F.col("n_tokens")
    rest = F.when(F.bit_count(n) == 1, 0).otherwise(F.lit(window) - n).cast("int")
    return (
        pieces.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("n_tokens"))
        .select("sequence_id", F.concat(ids, F.array_repeat(F.lit(pad_id), rest)).alias("input_ids"), "n_tokens", F.transform("parts", lambda p: F.struct(p.doc_id.alias("doc_id"), p.start.alias("start"), p.offset.alias("offset"))).alias("documents"))
    )
