"""Whitening of embeddings from the exact characteristic polynomial of their scatter matrix.

Vectors become whole numbers, so counts, sums and products of the fit list (each distinct vector
once) are exact integers, summed by Spark. The polynomial of the integer scatter matrix is found
modulo one prime per task (Hessenberg reduction) and put together by the Chinese remainder
theorem. All its roots are real, so the sign changes of the shifted polynomial count the roots
above a point exactly; bisection isolates the largest ones to 100 bits. Each root's components
come from inverse iteration in fixed-point integers, one root per task.

What the rows give: vectors that are null, hold null, NaN, infinite or huge entries (64 * c beyond
2^62) or whose length is not the most frequent one (of equally frequent ones the longest) are
dropped. Equal vectors count once in the fit but each row is whitened, whatever its id, which may
be null or repeated; other columns are not read. Directions without variance have no component,
so an empty table, one distinct vector or vectors of length 0 give no components and empty arrays.
Memory is bounded by the dimension, not the rows: the driver holds d * (d + 1) / 2 sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.session import materialise

#: Vectors of more entries are refused: the driver holds the square of this.
MOST_DIMENSIONS = 1024

#: Bits to which roots and components are worked out, beyond those of the numbers themselves.
BITS = 100

SCALE, OFFSET = 64, 1_000_000
_LIMB, _LIMBS = 40, 6  # exact sums travel as six numbers of 40 bits
_PART, _ROWS = 20, 4096  # products of 20-bit parts over 4096 rows stay below 2^53


# --- whole numbers -------------------------------------------------------------------------


def whole_vectors(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Rows (vec_id, x): the usable vectors as whole numbers, x = floor(64 c) + 1000000."""
    entries = F.transform(F.col(f"`{vector_column}`"), lambda c: c.cast("double") * SCALE)
    usable = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(1 << 62)))
    rows = df.select(F.col(f"`{id_column}`").alias("vec_id"), F.when(usable, entries).alias("scaled")).filter(F.col("scaled").isNotNull())
    length = rows.groupBy(F.size("scaled").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    wanted = length["length"] if length else 0
    if wanted > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {wanted} entries; at most {MOST_DIMENSIONS} are worked out exactly")
    return rows.filter(F.size("scaled") == wanted).select("vec_id", F.transform("scaled", lambda c: F.floor(c) + OFFSET).alias("x"))


def _matrix(vectors: pa.Array) -> np.ndarray:
    """The vectors of a batch, less the offset, one row each."""
    if not len(vectors):
        return np.zeros((0, 0), np.int64)
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1).astype(np.int64) - OFFSET


def _parts(y: np.ndarray) -> list[np.ndarray]:
    """Numbers below 2^20 in size with y = sum of part i * 2^(20 i)."""
    found = []
    while y.size and (y.max() >= 1 << _PART or y.min() <= -(1 << _PART)):
        found.append((y & ((1 << _PART) - 1)).astype(np.float64))
        y = y >> _PART
    return [*found, y.astype(np.float64)]


class _Sums:
    """Exact count, sums and sums of products of whole vectors."""

    def __init__(self) -> None:
        self.n, self.total = 0, None

    def add(self, y: np.ndarray) -> None:
        y = np.concatenate((np.ones((len(y), 1), np.int64), y), axis=1)  # the column of ones gives count and sums
        for begin in range(0, len(y), _ROWS):
            parts = _parts(y[begin : begin + _ROWS])
            for i, a in enumerate(parts):
                for j, b in enumerate(parts):
                    product = (a.T @ b).astype(np.int64).astype(object) << (_PART * (i + j))
                    self.total = product if self.total is None else self.total + product
        self.n += len(y)


_SUMS_SCHEMA = "i int, j int, " + ", ".join(f"limb{k} long" for k in range(_LIMBS))


def _sums_of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = _Sums()
    for batch in batches:
        if batch.num_rows:
            sums.add(_matrix(batch.column(0)))
    if sums.n:
        i, j = np.triu_indices(len(sums.total))
        values = sums.total[i, j]
        limbs = [((values >> (_LIMB * k)) & ((1 << _LIMB) - 1) if k < _LIMBS - 1 else values >> (_LIMB * k)).astype(np.int64) for k in range(_LIMBS)]
        names = ["i", "j", *(f"limb{k}" for k in range(_LIMBS))]
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in (i.astype(np.int32), j.astype(np.int32), *limbs)], names=names)


def exact_scatter(fit: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """Count n, sums S (of x less the offset) and n * sum(x x') - S S' of the vectors in ``fit``, all exact."""
    parts = fit.select("x").mapInArrow(_sums_of_partition, _SUMS_SCHEMA)
    rows = parts.groupBy("i", "j").agg(*[F.sum(f"limb{k}").alias(f"limb{k}") for k in range(_LIMBS)]).collect()
    if not rows:
        return 0, [], np.zeros((0, 0), object)
    size = 1 + max(r["j"] for r in rows)
    total = np.zeros((size, size), object)
    for r in rows:
        total[r["i"], r["j"]] = total[r["j"], r["i"]] = sum(r[f"limb{k}"] << (_LIMB * k) for k in range(_LIMBS))
    n, sums = total[0, 0], total[0, 1:]
    return n, sums.tolist(), n * total[1:, 1:] - np.outer(sums, sums)


# --- characteristic polynomial -------------------------------------------------------------


def _is_prime(n: int) -> bool:
    """Miller and Rabin's test; with these bases it is exact below 3.4 * 10^14."""
    if n < 2 or any(n % p == 0 for p in (2, 3, 5, 7, 11, 13, 17)):
        return n in (2, 3, 5, 7, 11, 13, 17)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7, 11, 13, 17):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_for(scatter: np.ndarray) -> list[int]:
    """Primes below 2^31 whose product exceeds twice every coefficient, and one more as a check.

    The roots are not negative, so coefficient k is at most comb(d, k) * (trace / d)^k.
    """
    d = len(scatter)
    mean = -(-int(np.trace(scatter)) // d) + 1
    bound, product, found, p = 2 * max(comb(d, k) * mean**k for k in range(d + 1)), 1, [], 1 << 31
    while product <= bound:
        p -= 1
        if _is_prime(p):
            product *= p
            found.append(p)
    p -= 1
    while not _is_prime(p):
        p -= 1
    return [*found, p]


def polynomial_modulo(scatter: np.ndarray, p: int) -> list[int]:
    """det(t I - scatter) modulo the prime p < 2^31, from the constant term up."""
    h = (scatter % p).astype(np.int64)
    d = len(h)
    for m in range(1, d - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        pivot = m + int(below[0])
        if pivot != m:
            h[[m, pivot]] = h[[pivot, m]]
            h[:, [m, pivot]] = h[:, [pivot, m]]
        factors = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - factors[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * factors % p).sum(axis=1)) % p
    leading = np.zeros((d + 1, d + 1), np.int64)  # row k: polynomial of the first k rows and columns
    leading[0, 0] = 1
    for k in range(1, d + 1):
        chain, weights = 1, np.zeros(k, np.int64)  # weights[r]: entry (r, k) times the subdiagonal from r to k
        for r in range(k - 1, -1, -1):
            weights[r] = int(h[r, k - 1]) * chain % p
            chain = chain * int(h[r, r - 1]) % p if r else 0
        leading[k, 1:] = leading[k - 1, :-1]
        leading[k] = (leading[k] - (weights[:, None] * leading[:k] % p).sum(axis=0)) % p
    return leading[d].tolist()


def characteristic_polynomial(spark: SparkSession, scatter: np.ndarray) -> list[int]:
    """The exact coefficients of det(t I - scatter) from the constant term up, one prime per task."""
    primes = primes_for(scatter)

    def residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(given, pa.int64()), pa.array([polynomial_modulo(scatter, p) for p in given], pa.list_(pa.int64()))], names=["prime", "residue"])

    tasks = min(len(primes), 4 * spark.sparkContext.defaultParallelism)
    given = spark.createDataFrame([(p,) for p in primes], "prime long").repartition(tasks)
    found = {r["prime"]: r["residue"] for r in given.mapInArrow(residues, "prime long, residue array<long>").collect()}
    product, value = 1, [0] * (len(scatter) + 1)
    for p in primes[:-1]:
        inverse = pow(product, -1, p)
        value = [v + product * ((r - v) * inverse % p) for v, r in zip(value, found[p])]
        product *= p
    value = [v - product if 2 * v > product else v for v in value]
    if [v % primes[-1] for v in value] != found[primes[-1]]:
        raise ArithmeticError("the polynomial does not agree with the check prime")
    return value


# --- roots ---------------------------------------------------------------------------------


def roots_above(polynomial: list[int], point: int, bits: int) -> int:
    """How many roots of a polynomial with real roots only exceed point / 2^bits, with multiplicity."""
    d = len(polynomial) - 1
    c = [v << (bits * (d - i)) for i, v in enumerate(polynomial)]  # roots times 2^bits
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            c[j] += point * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _sign(polynomial: list[int], point: int, bits: int) -> int:
    value, scale = 0, 0
    for v in reversed(polynomial):
        value = value * point + (v << scale)
        scale += bits
    return (value > 0) - (value < 0)


@dataclass
class Root:
    """A root, at least low / 2^bits and at most (low + 1) / 2^bits, and how many coincide there."""

    low: int
    bits: int
    count: int

    @property
    def value(self) -> Fraction:
        return Fraction(2 * self.low + 1, 2 << self.bits)


def largest_roots(polynomial: list[int], wanted: int) -> list[Root]:
    """The positive roots from the largest on, until ``wanted`` of them are counted."""
    zeros = next(i for i, v in enumerate(polynomial) if v)
    polynomial = polynomial[zeros:]
    d = len(polynomial) - 1
    found: list[Root] = []
    if d == 0:
        return found
    top = -polynomial[d - 1] + 1  # roots are positive and sum to this less one
    width = 1 << top.bit_length()
    # intervals (low, low + size] of a grid of 1 / 2^bits, the largest one last
    todo = [(0, width, 0, d, 0)]
    while todo and sum(r.count for r in found) < wanted:
        low, size, bits, above_low, above_high = todo.pop()
        inside = above_low - above_high
        if inside == 0:
            continue
        if size == 1 and max(low, 1).bit_length() > BITS:
            found.append(Root(low, bits, inside))
            continue
        if inside == 1 and low > 0:
            found.append(_refined(polynomial, low, size, bits))
            continue
        if size == 1:
            low, size, bits = 2 * low, 2, bits + 1
        middle = low + size // 2
        above = roots_above(polynomial, middle, bits)
        todo += [(low, middle - low, bits, above_low, above), (middle, size - size // 2, bits, above, above_high)]
    return found


def _refined(polynomial: list[int], low: int, size: int, bits: int) -> Root:
    """The only root in (low, low + size], bisected by the sign of the polynomial."""
    high = low + size
    at_high = _sign(polynomial, high, bits)
    if at_high == 0:
        return _exact(high, bits)
    while high - low > 1 or low.bit_length() <= BITS:
        if high - low == 1:
            low, high, bits = 2 * low, 2 * high, bits + 1
        middle = (low + high) // 2
        sign = _sign(polynomial, middle, bits)
        if sign == 0:
            return _exact(middle, bits)
        low, high = (low, middle) if sign == at_high else (middle, high)
    return Root(low, bits, 1)


def _exact(point: int, bits: int) -> Root:
    more = max(0, BITS + 1 - point.bit_length())
    return Root(point << more, bits + more, 1)


# --- components ----------------------------------------------------------------------------


def _null_vectors(scatter: np.ndarray, root: Root) -> list[list[float]]:
    """Orthonormal vectors of the null space of scatter - root, by inverse iteration in fixed point."""
    d = len(scatter)
    point = 2 * BITS + max(int(abs(v)).bit_length() for v in scatter.flat) + d.bit_length()
    one = 1 << point
    shifted = scatter * one
    value = int(root.value * one)
    for i in range(d):
        shifted[i, i] -= value
    order = np.arange(d)
    for k in range(d):  # lower and upper triangle in place, rows swapped so that factors stay below one
        pivot = k + max(range(d - k), key=lambda i: abs(shifted[k + i, k]))
        if pivot != k:
            shifted[[k, pivot]] = shifted[[pivot, k]]
            order[[k, pivot]] = order[[pivot, k]]
        if shifted[k, k] == 0:
            shifted[k, k] = 1
        if k + 1 < d:
            shifted[k + 1 :, k] = (shifted[k + 1 :, k] * one) // shifted[k, k]
            shifted[k + 1 :, k + 1 :] -= (shifted[k + 1 :, k, None] * shifted[k, None, k + 1 :]) >> point
    found: list[np.ndarray] = []
    random = np.random.default_rng(1)
    while len(found) < root.count:
        v = _unit(np.array([int(x) for x in random.integers(-(1 << 30), 1 << 30, d)], object), one)
        for _ in range(3):
            v = v[order]
            for k in range(d):
                v[k + 1 :] -= (shifted[k + 1 :, k] * v[k]) >> point
            for k in range(d - 1, -1, -1):
                v[k] = (v[k] * one) // shifted[k, k]
                v[:k] -= (shifted[:k, k] * v[k]) >> point
            v = _unit(v, one)
            for w in found:
                v = v - ((v * w).sum() // one * w >> point)
            v = _unit(v, one)
        found.append(v)
    rounded = [[float(Fraction(int(x), one)) for x in v] for v in found]
    return [[-x for x in v] if v[max(range(d), key=lambda i: abs(v[i]))] < 0 else v for v in rounded]


def _unit(v: np.ndarray, one: int) -> np.ndarray:
    """``v`` of length one in fixed point."""
    from math import isqrt

    size = max(int(abs(x)) for x in v)
    v = v * one // max(size, 1)
    return v * one // max(isqrt(int((v * v).sum())), 1)


# --- the model -----------------------------------------------------------------------------


@dataclass
class Whitening:
    """n, sums of the fit list, unit components (rows), square roots of their roots, shares of the trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    roots: np.ndarray
    explained: list[float]
    identity_error: float = 0.0

    def deviations(self, y: np.ndarray) -> np.ndarray:
        """n * y - S as exact whole numbers."""
        largest = max([int(abs(y).max()) if y.size else 0, *map(abs, self.sums), 1])
        if 2 * self.n * largest < 1 << 62:
            return y * self.n - np.array(self.sums, np.int64)
        return y.astype(object) * self.n - np.array(self.sums, object)

    def whitened(self, deviations: np.ndarray) -> np.ndarray:
        return deviations.astype(np.float64) @ self.vectors.T / self.roots


def fit(vectors: DataFrame, components: int = 16) -> Whitening:
    """The whitening of the distinct vectors of ``vectors`` (column x)."""
    spark = vectors.sparkSession
    distinct = materialise(vectors.select("x").distinct())
    n, sums, scatter = exact_scatter(distinct)
    d = len(sums)
    if n < 2 or not np.trace(scatter):
        return Whitening(n, sums, np.zeros((0, d)), np.zeros(0), [])
    roots = largest_roots(characteristic_polynomial(spark, scatter), components)

    def null_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(given, pa.int64()), pa.array([_null_vectors(scatter, roots[i]) for i in given], pa.list_(pa.list_(pa.float64())))], names=["root", "vectors"])

    found = spark.range(0, len(roots), 1, len(roots)).mapInArrow(null_vectors, "root long, vectors array<array<double>>").collect()
    by_root = {r["root"]: r["vectors"] for r in found}
    pairs = [(v, r.value) for i, r in enumerate(roots) for v in by_root[i]][:components]
    trace = int(np.trace(scatter))
    model = Whitening(n, sums, np.array([v for v, _ in pairs]), np.array([float(e) ** 0.5 for _, e in pairs]), [float(e / trace) for _, e in pairs])
    model.identity_error = _identity_error(distinct, model)
    return model


def _identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Largest difference between the covariance of the whitened fit list, as computed, and the identity."""
    k = len(model.roots)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            if batch.num_rows:
                z = model.whitened(model.deviations(_matrix(batch.column(0))))
                z = np.concatenate((np.ones((len(z), 1)), z), axis=1)
                total += z.T @ z
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], names=["i", "j", "total"])

    total = np.zeros((k + 1, k + 1))
    for r in distinct.select("x").mapInArrow(products, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect():
        total[r["i"], r["j"]] = r["total"]
    mean = total[0, 1:] / model.n
    return float(np.abs(total[1:, 1:] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, model: Whitening) -> DataFrame:
    """Rows (vec_id, n, deviation, whitened): every row of ``vectors``, its whitened entries in component order.

    ``deviation``, the sum of (n x - S)^2, is exact in 38 digits; beyond them it is null.
    """
    id_type = vectors.schema["vec_id"].dataType.simpleString()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            away = model.deviations(_matrix(batch.column(1)))
            if away.dtype != object and (not away.size or int(np.abs(away).max()) ** 2 * away.shape[1] < 1 << 63):
                squares = pa.array((away * away).sum(axis=1).astype(np.int64)) if away.size else pa.array([0] * rows, pa.int64())
                squares = squares.cast(pa.decimal128(38, 0))
            else:
                exact = (away.astype(object) ** 2).sum(axis=1)
                squares = pa.array([int(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))
            z = model.whitened(away) if len(model.roots) else np.zeros((rows, 0))
            offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * z.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), squares, pa.ListArray.from_arrays(offsets, pa.array(z.ravel()))], names=["vec_id", "deviation", "whitened"])

    found = vectors.select("vec_id", "x").mapInArrow(project, f"vec_id {id_type}, deviation decimal(38,0), whitened array<double>")
    return found.select("vec_id", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened")


def by_component(whitened: DataFrame, model: Whitening) -> DataFrame:
    """One row for each vector and component, numbered from 1, with the component's share and the error of the fit."""
    shares: Column = F.array(*[F.lit(s) for s in model.explained]) if model.explained else F.array().cast("array<double>")
    rows = whitened.select("vec_id", "n", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return rows.select(
        "vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", "whitened", F.get(shares, F.col("place")).alias("explained"), F.lit(model.identity_error).alias("identity_error")
    )
