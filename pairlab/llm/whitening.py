"""Whitening of embeddings by principal components that come from an exact characteristic polynomial.

Entries become integers, x = floor(scale * c) + offset. With n vectors and sums S, the scatter M = n * sum(x x') - S S'
is an integer matrix, n * n times the covariance; it is summed exactly, so it is the same whether vectors are centred
before they are multiplied or, as here, about a fixed integer (offset). Its characteristic polynomial comes from residues
modulo primes, one Hessenberg reduction a prime, spread over tasks and joined by Chinese remainders for each
coefficient. All roots are real and none is negative, so the sign changes of the polynomial shifted by a count the roots
above a exactly (Descartes' rule), with their multiplicity; by that each root is isolated and halved down to PRECISION
bits, in a task of its own, which then finds the null vectors of M less the root by inverse iteration in integers.
Roots that are equal to PRECISION bits share a space, of which each takes one of the orthonormal vectors.

What goes to the driver is bounded by the dimension: sizes, moments, coefficients and components.

Defined cases: vectors that are null, empty or hold null or non-finite entries take no part, nor do those with an entry
of 2**55 or more in size, whose integers aren't longs, or of another dimension than most have (of dimensions that are
equally common the smallest counts); rows with a null id take part; repeated rows each take part; components without
variance can't be whitened and are left out, so where all vectors are equal, or there are none, the result is empty;
deviation is null where it isn't a long; extra columns are carried only by name in ``keep``, and the operator's own
columns win over names that clash.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Significant bits of the smallest root, and fraction bits of the inverse iteration.
PRECISION = 200
FRACTION = 400
#: Moments are summed as two parts, the lower of so many bits.
LOW_BITS = 60
LIMB_BITS = 20
BLOCK_ROWS = 4096

MOMENTS = "i int, j int, high decimal(38,0), low decimal(38,0)"


def integer_entries(vector: Column, scale: int, offset: int) -> Column:
    """floor(scale * c) + offset of the entries of a vector of doubles."""
    return F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c) + F.lit(offset))


def usable(vector: Column, limit: float) -> Column:
    """Whether a vector of doubles has entries, all of them finite and smaller than limit."""
    return (F.size(vector) > 0) & F.forall(vector, lambda c: F.coalesce(F.abs(c) < limit, F.lit(False)))


def vectors_of(column: pa.Array) -> np.ndarray:
    """The rows of a list column whose lists have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def exact_gram(rows: np.ndarray) -> np.ndarray:
    """rows' rows as Python integers: products of limbs, whose sums floating point holds exactly."""
    limbs = []
    while np.abs(rows).max(initial=0) >= 1 << LIMB_BITS:
        limbs.append((rows & ((1 << LIMB_BITS) - 1)).astype(np.float64))
        rows = rows >> LIMB_BITS
    limbs.append(rows.astype(np.float64))
    total = np.zeros((rows.shape[1],) * 2, object)
    for a, left in enumerate(limbs):
        for b, right in enumerate(limbs):
            for k in range(0, len(rows), BLOCK_ROWS):
                part = left[k : k + BLOCK_ROWS].T @ right[k : k + BLOCK_ROWS]
                total += part.astype(np.int64).astype(object) << (LIMB_BITS * (a + b))
    return total


def integer_moments(vectors: DataFrame, offset: int) -> DataFrame:
    """MOMENTS of the integer vectors about offset: products at (i, j), i <= j, sums at (-1, j), the count at (-1, -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, gram = 0, 0, 0
        for batch in batches:
            rows = vectors_of(batch.column(0)) - offset
            if len(rows):
                sums = ((rows >> 32).sum(axis=0).astype(object) << 32) + (rows & 0xFFFFFFFF).sum(axis=0)
                n, total, gram = n + len(rows), total + sums, gram + exact_gram(rows)
        if not n:
            return
        d = len(total)
        cells = [(-1, -1, n), *((-1, j, total[j]) for j in range(d)), *((i, j, gram[i, j]) for i in range(d) for j in range(i, d))]
        i, j, v = zip(*cells, strict=True)
        wide = pa.decimal128(38, 0)
        parts = [pa.array([f(int(x)) for x in v], wide) for f in (lambda x: x >> LOW_BITS, lambda x: x & ((1 << LOW_BITS) - 1))]
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *parts], names=["i", "j", "high", "low"])

    sums = [F.sum(c).cast("decimal(38,0)").alias(c) for c in ("high", "low")]
    return vectors.mapInArrow(run, MOMENTS).groupBy("i", "j").agg(*sums)


def primes_below(limit: int, product: int) -> list[int]:
    """The largest primes below limit (at most 2**31) whose product is beyond a number."""
    small = np.ones(1 << 16, bool)
    small[:2] = False
    for p in range(2, 1 << 8):
        if small[p]:
            small[p * p :: p] = False
    small = np.flatnonzero(small)
    out, reached, n = [], 1, limit - 1
    while reached <= product:
        if np.all(n % small[small * small <= n]):
            out.append(n)
            reached *= n
        n -= 1
    return out


def charpoly_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """The coefficients modulo p, from that of the highest power, of a matrix's characteristic polynomial."""
    h, d = np.array(matrix % p, np.int64), len(matrix)
    for m in range(1, d - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        i = m + int(below[0])
        if i != m:
            h[[i, m]] = h[[m, i]]
            h[:, [i, m]] = h[:, [m, i]]
        u = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :, m - 1 :] = (h[m + 1 :, m - 1 :] - u[:, None] * h[m, m - 1 :]) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * u % p).sum(axis=1)) % p
    # Row k has the polynomial of the first k rows and columns, from the constant on.
    poly = np.zeros((d + 1, d + 1), np.int64)
    poly[0, 0] = 1
    for k in range(d):
        poly[k + 1, 1:] = poly[k, :-1]
        weights, below = np.zeros(k + 1, np.int64), 1
        for i in range(k, -1, -1):
            weights[i] = h[i, k] * below % p
            if i:
                below = below * int(h[i, i - 1]) % p
        poly[k + 1] = (poly[k + 1] - (weights[:, None] * poly[: k + 1] % p).sum(axis=0)) % p
    return poly[d, ::-1]


def symmetric_functions(vectors: DataFrame, matrix: np.ndarray) -> list[int]:
    """The elementary symmetric functions e_0 to e_d of the eigenvalues of an integer matrix that has no negative ones."""
    spark, d = vectors.sparkSession, len(matrix)
    trace = int(np.trace(matrix))
    # No function of order k is beyond binomial(d, k) * (trace / d)**k.
    bound = max(math.comb(d, k) * trace**k // d**k for k in range(d + 1)) + 1
    primes = primes_below(1 << 31, bound)
    sign = np.array([(-1) ** k for k in range(d + 1)])

    def residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                values = charpoly_mod(matrix, p) * sign % p
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(d + 1, dtype=np.int32)), pa.array(np.full(d + 1, p)), pa.array(values)], names=["k", "prime", "residue"])

    def remainder(part: pa.Table) -> pa.Table:
        x, modulus = 0, 1
        for p, r in zip(part["prime"].to_pylist(), part["residue"].to_pylist(), strict=True):
            x += modulus * ((r - x) * pow(modulus, -1, p) % p)
            modulus *= p
        return pa.table({"k": pa.array([part["k"][0].as_py()], pa.int32()), "value": [f"{x:x}"]})

    tasks = min(len(primes), spark.sparkContext.defaultParallelism)
    spread = spark.createDataFrame([(p,) for p in primes], "prime long").repartition(tasks)
    found = spread.mapInArrow(residues, "k int, prime long, residue long").groupBy("k").applyInArrow(remainder, "k int, value string")
    values = {r.k: int(r.value, 16) for r in found.collect()}
    return [values[k] for k in range(d + 1)]


class RealRoots:
    """The positive roots, in integers of 2**-shift, of a polynomial with real roots of which none is negative."""

    def __init__(self, functions: list[int]):
        while functions[-1] == 0:  # as many roots are zero
            functions = functions[:-1]
        self.rank = len(functions) - 1
        # The smallest root is at least the quotient of the last two functions.
        least = functions[-1].bit_length() - functions[-2].bit_length() if self.rank else 0
        self.shift = max(0, PRECISION - least)
        self.coefficients = [(-1) ** k * e << (self.shift * k) for k, e in enumerate(functions)]
        self.top = (functions[1] << self.shift) + 1 if self.rank else 0

    def above(self, a: int) -> int:
        """How many roots are greater than a."""
        c = list(self.coefficients)
        for stop in range(len(c) - 1, 0, -1):
            for k in range(stop):
                c[k + 1] += a * c[k]
        signs = [x > 0 for x in c if x]
        return sum(s != t for s, t in zip(signs, signs[1:], strict=False))

    def negative(self, a: int) -> bool:
        """Whether the value at a is below zero."""
        value = 0
        for c in self.coefficients:
            value = value * a + c
        return value < 0

    def root(self, k: int) -> tuple[int, int, int]:
        """The k-th largest root (from 1), to the next lower integer; its place among those equal, and their number."""
        low, high, more, fewer = 0, self.top, self.rank, 0  # roots above low, and above high
        while high - low > 1 and more - fewer > 1:
            middle = (low + high) // 2
            n = self.above(middle)
            if n >= k:
                low, more = middle, n
            else:
                high, fewer = middle, n
        if more - fewer == 1:
            sign = self.negative(high) if self.above(high) == self.above(high - 1) else None
            while high - low > 1:  # the one root in between changes the sign
                middle = (low + high) // 2
                beyond = self.above(middle) < k if sign is None else self.negative(middle) == sign
                if beyond:
                    high = middle
                else:
                    low = middle
        return low, k - fewer - 1, more - fewer


def solved(matrix: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The solution, up to a factor, of linear equations in fixed point; a pivot that vanishes counts as the least number."""
    a, b, d = matrix << FRACTION, right << FRACTION, len(matrix)
    for k in range(d):
        i = k + int(np.argmax(np.abs(a[k:, k])))
        if i != k:
            a[[i, k]], b[[i, k]] = a[[k, i]], b[[k, i]]
        if a[k, k] == 0:
            a[k, k] = 1
        for i in range(k + 1, d):
            if a[i, k]:
                f = a[i, k]
                a[i, k:] -= f * a[k, k:] // a[k, k]
                b[i] -= f * b[k] // a[k, k]
    x = np.zeros_like(b)
    for k in range(d - 1, -1, -1):
        x[k] = ((b[k] - (a[k, k + 1 :, None] * x[k + 1 :]).sum(axis=0) // (1 << FRACTION)) << FRACTION) // a[k, k]
    return x


def shortened(x: np.ndarray) -> np.ndarray:
    """Columns divided by powers of two, so that their largest entries have FRACTION bits."""
    out = x.copy()
    for j in range(x.shape[1]):
        bits = max(int(abs(v)).bit_length() for v in x[:, j]) - FRACTION
        out[:, j] = x[:, j] >> bits if bits > 0 else x[:, j] << -bits
    return out


def null_vectors(matrix: np.ndarray, count: int) -> np.ndarray:
    """count orthonormal vectors of doubles, as columns, on which an integer matrix has its values nearest to zero."""
    d = len(matrix)
    x = np.array([[(i * i * 2654435761 + (i + 7) * (j + 3) * 40503) % 65537 - 32768 for j in range(count)] for i in range(d)], object)
    for _ in range(3):
        x = shortened(solved(matrix, x))
        for j in range(count):  # what columns have in common goes
            for i in range(j):
                dot, own = (x[:, i] * x[:, j]).sum(), (x[:, i] * x[:, i]).sum()
                x[:, j] = x[:, j] - x[:, i] * dot // own
            x = shortened(x)
    out = np.array([[float(v / (1 << FRACTION)) for v in row] for row in x])
    out /= np.sqrt((out * out).sum(axis=0))
    return out * np.sign(out[np.abs(out).argmax(axis=0), np.arange(count)])


COMPONENT = "component int, variance double, explained double, vector array<double>"


def principal_components(vectors: DataFrame, matrix: np.ndarray, n: int, most: int) -> list[tuple[int, float, float, list[float]]]:
    """COMPONENT rows of the covariance matrix / n**2, by falling variance, as far as it has any."""
    functions = symmetric_functions(vectors, matrix)
    roots, trace = RealRoots(functions), functions[1]
    wanted = min(most, roots.rank)
    if not wanted:
        return []
    spark = vectors.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                y, place, count = roots.root(k)
                shifted = matrix << roots.shift
                shifted[np.diag_indices(len(matrix))] -= y
                vector = null_vectors(shifted, count)[:, place]
                unit = 1 << roots.shift
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32()), pa.array([y / (unit * n * n)]), pa.array([y / (unit * trace)]), pa.array([vector.tolist()])],
                    names=["component", "variance", "explained", "vector"],
                )

    # A task for each root at most.
    numbers = spark.createDataFrame([(k,) for k in range(1, wanted + 1)], "component int")
    found = numbers.repartition(min(wanted, 2 * spark.sparkContext.defaultParallelism)).mapInArrow(run, COMPONENT)
    return sorted((r.component, r.variance, r.explained, r.vector) for r in found.collect())


def centred(rows: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S of each entry, exactly: as longs where they are such, else as Python integers."""
    low = np.array([s // n for s in sums], object)
    rest = np.array([s % n for s in sums], object)
    if max(abs(int(v)) for v in low) < 1 << 62:
        near = rows - low.astype(np.int64)
        if n * (int(np.abs(near).max(initial=0)) + 1) < 1 << 62:
            return near * n - rest.astype(np.int64)
    return rows.astype(object) * n - np.array(sums, object)


def deviations(rows: np.ndarray) -> list[int | None]:
    """The sum of squares of each row, exactly; None where it isn't a long."""
    if rows.dtype != object and int(np.abs(rows).max(initial=0)) ** 2 * rows.shape[1] < 1 << 63:
        return (rows * rows).sum(axis=1).tolist()
    exact = rows.astype(object)
    return [v if v < 1 << 63 else None for v in (exact * exact).sum(axis=1)]


def identity_error(vectors: DataFrame, project: Callable[[np.ndarray], np.ndarray], d: int) -> float:
    """The largest entry, in size, of the projections' covariance less the identity."""
    schema = "i int, j int, n long, mi double, mj double, c double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, cross = 0, np.zeros(d), np.zeros((d, d))
        for batch in batches:
            w = project(vectors_of(batch.column(0)))[1] if batch.num_rows else np.zeros((0, d))
            if not len(w):
                continue
            own = w.mean(axis=0)
            step, whole = own - mean, n + len(w)
            cross += (w - own).T @ (w - own) + np.outer(step, step) * (n * len(w) / whole)
            mean, n = mean + step * (len(w) / whole), whole
        if n:
            i, j = np.triu_indices(d)
            columns = [i.astype(np.int32), j.astype(np.int32), np.full(len(i), n), mean[i], mean[j], cross[i, j]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["i", "j", "n", "mi", "mj", "c"])

    n = F.sum("n")
    between = F.sum(F.expr("n * mi * mj")) - F.sum(F.expr("n * mi")) * F.sum(F.expr("n * mj")) / n
    merged = vectors.mapInArrow(run, schema).groupBy("i", "j").agg(((F.sum("c") + between) / n).alias("v"))
    return merged.agg(F.max(F.abs(F.col("v") - (F.col("i") == F.col("j")).cast("double")))).first()[0]


def whiten(
    df: DataFrame,
    vec_col: str = "embedding",
    id_col: str = "vec_id",
    keep: tuple[str, ...] = (),
    components: int = 32,
    scale: int = 64,
    offset: int = 1_000_000,
) -> DataFrame:
    """A row for each usable vector and component: id_col and keep, component, n, deviation, whitened, explained, identity_error.

    deviation is the exact sum of squares of n * x - S; whitened is the centred vector along the component, in standard
    deviations; explained is the component's part of the variance; identity_error is one value for the whole table.
    """
    own = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    own_fields = T.StructType.fromDDL(own)
    fields = [df.schema[c] for c in dict.fromkeys((id_col, *keep)) if c not in own_fields.names]
    schema = T.StructType([*fields, *own_fields])
    vector = df[vec_col].cast("array<double>")
    rows = df.where(usable(vector, 2.0**55)).select(
        integer_entries(vector, scale, offset).alias("x"),
        *(df[f.name].alias(str(i)) for i, f in enumerate(fields)),
    )
    commonest = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if commonest is None:
        return df.sparkSession.createDataFrame([], schema)
    d = commonest["d"]
    rows = rows.where(F.size("x") == d)
    vectors = rows.select("x")
    cells = {(r.i, r.j): (int(r.high) << LOW_BITS) + int(r.low) for r in integer_moments(vectors, offset).collect()}
    n = cells[-1, -1]
    shifted = [cells[-1, j] for j in range(d)]
    matrix = np.array([[n * cells[min(i, j), max(i, j)] - shifted[i] * shifted[j] for j in range(d)] for i in range(d)], object)
    found = principal_components(vectors, matrix, n, components)
    if not found:
        return df.sparkSession.createDataFrame([], schema)
    sums = [s + n * offset for s in shifted]
    k = len(found)
    axes = np.array([v for *_, v in found]).T / np.sqrt([v for _, v, *_ in found])
    explained = np.array([e for _, _, e, _ in found])

    def project(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        exact = centred(x, n, sums)
        return exact, (exact / n).astype(np.float64) @ axes

    error = identity_error(vectors, project, k)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            exact, white = project(vectors_of(batch.column(0)))
            at = pa.array(np.repeat(np.arange(size), k))
            yield pa.RecordBatch.from_arrays(
                [
                    *(c.take(at) for c in batch.columns[1:]),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)),
                    pa.array(np.full(size * k, n)),
                    pa.array(deviations(exact), pa.int64()).take(at),
                    pa.array(white.ravel()),
                    pa.array(np.tile(explained, size)),
                    pa.array(np.full(size * k, error)),
                ],
                names=names,
            )

    return rows.mapInArrow(run, schema)
