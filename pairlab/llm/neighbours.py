"""Nearest neighbours by inner product: a join of blocks whose int8 products rule out most pairs, exactly.

Queries and candidates are dealt into blocks of bounded size by hashed row numbers, so no vector, however common, fills a
block, and each pair of blocks is a tile of its own. A tile quantises its vectors to int8, each with its own scale, and
multiplies all of them at once; with the norms of what quantisation left out, each product has bounds on the inner
product. A pair whose upper bound is below its query's k-th lower bound can't be among the k nearest; the rest are
computed again from the vectors, in double precision, component by component in order. Each tile passes on k pairs a
query at most, which heaps merge. Nothing is approximate: bounds only decide what need not be computed again.

Defined cases: vectors that are null, empty, zero or hold null or non-finite entries take no part, nor do rows with a
null id; vectors meet those of their own length only; rows are told apart by themselves, so a row that repeats a query's
id is a candidate, and a query row that is there twice returns its list twice; an inner product that is not a number
(after an overflow) counts as the least; fewer candidates than k are all returned; columns other than id and vector are
not carried, so their names can't clash; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.llm.common import cut

#: Rows of a block of queries, and of candidates, on average; queries whose products are held at once.
QUERY_ROWS = 8192
BLOCK_ROWS = 4096
AT_ONCE = 256
#: Products of int8 sum up exactly in 24 bits over so many components.
EXACT_WIDTH = 1024

PAIR = "query_row long, query_id long, vec_id long, score double"
RESULT = "query_id long, rank int, vec_id long, score double"


def quantised(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, the norms of what they stand for, and the norms of what they leave out."""
    scale = np.abs(v).max(axis=1) / 127
    scale = np.where(scale > 0, scale, np.finfo(float).tiny)
    codes = np.clip(np.rint(v / scale[:, None]), -127, 127)
    stood = codes * scale[:, None]
    return codes.astype(np.int8), scale, np.sqrt((stood * stood).sum(axis=1)), np.sqrt(((v - stood) ** 2).sum(axis=1))


def int8_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of int8 rows, exactly."""
    parts = (
        (a[:, k : k + EXACT_WIDTH].astype(np.float32) @ b[:, k : k + EXACT_WIDTH].astype(np.float32).T).astype(np.float64)
        for k in range(0, a.shape[1], EXACT_WIDTH)
    )
    return sum(parts)


def inner_products(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """a[i] times b[j], pair by pair, summed in the order of the components."""
    total = np.zeros(len(i))
    for k in range(a.shape[1]):
        total += a[i, k] * b[j, k]
    return total


def tile_pairs(q: np.ndarray, c: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, candidate, score) of each query's k nearest in the tile; own has the candidate that is the query, or -1."""
    with np.errstate(over="ignore", invalid="ignore"):
        cb, c_scale, c_stood, c_left = quantised(c)
        qb, q_scale, q_stood, q_left = quantised(q)
        c_norm, slack = c_stood + c_left, 1e-12 * (1 + q.shape[1] / 1024)
        for at in range(0, len(q), AT_ONCE):
            part = slice(at, at + AT_ONCE)
            near = int8_products(qb[part], cb) * q_scale[part, None] * c_scale
            # |uv - u'v'| <= |u - u'| |v| + |u'| |v - v'|, and what rounding adds.
            error = q_left[part, None] * c_norm + q_stood[part, None] * c_left
            error = error * (1 + 1e-9) + (q_stood + q_left)[part, None] * c_norm * slack
            selves = np.flatnonzero(own[part] >= 0)
            low = near - error
            low[selves, own[part][selves]] = -np.inf
            low = np.where(np.isnan(low), -np.inf, low)
            if low.shape[1] > k:
                least = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k]
            else:
                least = np.full(len(low), -np.inf)
            left = ~(near + error < least[:, None])  # true where the bound is no number
            left[selves, own[part][selves]] = False
            i, j = np.nonzero(left)
            score = inner_products(q, i + at, c, j)
            score = np.where(np.isnan(score), -np.inf, score)
            order = np.lexsort((ids[j], -score, i))
            i, j, score = i[order], j[order], score[order]
            first = np.searchsorted(i, np.arange(len(low)))
            kept = np.arange(len(i)) - first[i] < k
            yield i[kept] + at, j[kept], score[kept]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def merged(pairs: DataFrame, k: int) -> DataFrame:
    """RESULT from PAIR rows: a heap of the k nearest of each query, which come one query after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, query, heap, out = None, None, [], []

        def ended() -> None:
            best = sorted(heap, reverse=True)
            out.extend((query, rank, -vec, score) for rank, (score, vec) in enumerate(best, 1))

        for batch in batches:
            for row, query_id, vec, score in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row != now:
                    ended()
                    now, query, heap = row, query_id, []
                if len(heap) < k:
                    heapq.heappush(heap, (score, -vec))
                else:
                    heapq.heappushpop(heap, (score, -vec))
            if out:
                yield _result(out)
                out.clear()
        ended()
        if out:
            yield _result(out)

    def _result(rows: list[tuple]) -> pa.RecordBatch:
        q, rank, vec, score = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(q, pa.int64()), pa.array(rank, pa.int32()), pa.array(vec, pa.int64()), pa.array(score, pa.float64())],
            names=["query_id", "rank", "vec_id", "score"],
        )

    return pairs.repartition("query_row").sortWithinPartitions("query_row").mapInArrow(run, RESULT)


def nearest(
    df: DataFrame,
    queries: Column,
    k: int = 20,
    vec_col: str = "embedding",
    id_col: str = "vec_id",
    query_rows: int = QUERY_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """RESULT: the k rows of largest inner product with each row for which queries holds (over id and vector), nearest first.

    Ties go to the smaller id. Ids are longs.
    """
    vector = df[vec_col].cast("array<double>")
    fit = F.forall(vector, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False))) & F.exists(vector, lambda c: c != 0)
    chosen = df.where(df[id_col].isNotNull() & fit).select(
        df[id_col].cast("long").alias("id"),
        vector.alias("v"),
        F.coalesce(queries, F.lit(False)).alias("asks"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = cut(chosen)  # both sides have the same row numbers
    n, asking = rows.agg(F.count("*"), F.count_if("asks")).first()
    wide, high = -(-n // block_rows) or 1, -(-asking // query_rows) or 1
    block = lambda parts: F.pmod(F.xxhash64("row"), F.lit(parts))
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    sides = [
        rows.where("asks").select("row", "id", "v", block(high).cast("int").alias("a"), each(wide).alias("b")),
        rows.select("row", "id", "v", each(high).alias("a"), block(wide).cast("int").alias("b")),
    ]
    grouped = [s.withColumn("d", F.size("v")).groupBy("d", "a", "b") for s in sides]
    names = PAIR.replace(" long", "").replace(" double", "").split(", ")

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
        if left.num_rows and right.num_rows:
            q_row, q_id, c_row, c_id = (t[c].to_numpy() for t in (left, right) for c in ("row", "id"))
            order = np.argsort(c_row)
            at = np.minimum(np.searchsorted(c_row[order], q_row), len(order) - 1)
            own = np.where(c_row[order][at] == q_row, order[at], -1)
            parts = [(q_row[i], q_id[i], c_id[j], s) for i, j, s in tile_pairs(_matrix(left["v"]), _matrix(right["v"]), own, c_id, k)]
            found = [np.concatenate(x) for x in zip(*parts, strict=True)]
        return pa.table(dict(zip(names, found, strict=True)))

    return merged(grouped[0].cogroup(grouped[1]).applyInArrow(tile, PAIR), k)
