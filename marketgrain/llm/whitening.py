"""Whitening of embeddings from an exact scatter matrix, by residue numbers.

Entries become integers. Each distinct vector is fitted once: n vectors x with sums S. The scatter of the centred integers
y = n * x - S is built without rounding: every task takes y modulo several primes below 2**20 and multiplies blocks of
8,192 rows as doubles, whose sums stay below 2**53; residues are added over all tasks, and Chinese remaindering gives the
scatter itself, since the primes' product is chosen to exceed twice its bound, n**3 times the square of the widest range.
The covariance is that integer over n**3, rounded once to a double, and ``numpy.linalg.eigh`` takes it apart.

Per task a row for each prime and pair of dimensions is sent, so what travels depends on the dimensions (some hundreds to a
thousand are meant), not on the rows; the driver gets the reduced residues only.

Nulls and edges: vectors that are missing (see ``vectors``) give no rows; a null vec_id is an id like any other; repeated
rows are fitted once and each returned; entries of 2**40 or more in size raise a ValueError; a deviation beyond a long is
null; components without variance (rank below their number, or a single vector) have a null ``whitened``, and an
``explained`` of 0, null if nothing varies; ``identity_error`` is over those that vary, 0 if none does; an empty table
gives no rows; further columns are ignored whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketgrain.llm.shared import cleared, written
from marketgrain.llm.vectors import matrix, usual_length

SCALE, SHIFT = 64, 1_000_000
#: Primes lie below 2**PRIME_BITS, so BLOCK products of two residues add up to less than 2**53.
PRIME_BITS = 20
BLOCK = 1 << (53 - 2 * PRIME_BITS)
#: Entries are smaller than this in size.
MOST = 2.0**40
_HALF = 20


def primes(least_product: int) -> list[int]:
    """The greatest primes below 2**PRIME_BITS, as many as their product needs to exceed ``least_product``."""
    sieve = np.ones(1 << PRIME_BITS, bool)
    sieve[:2] = False
    for i in range(2, 1 << (PRIME_BITS // 2)):
        if sieve[i]:
            sieve[i * i :: i] = False
    found, product = [], 1
    for p in np.flatnonzero(sieve)[::-1].tolist():
        found.append(p)
        product *= p
        if product > least_product:
            return found
    raise ValueError("the numbers are too large")


def remaindered(residues: list[int], moduli: list[int]) -> int:
    """The integer of least size that has these residues."""
    product = math.prod(moduli)
    total = sum(r * (product // p) * pow(product // p, -1, p) for r, p in zip(residues, moduli)) % product
    return total - product if 2 * total > product else total


def integers(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers, and each vector as integers x = floor(SCALE * c) + SHIFT."""
    rows, found = matrix(column, length)
    if found.size and np.abs(found).max() >= MOST:
        raise ValueError(f"an entry has a size of {MOST:g} or more")
    return rows, np.floor(found * SCALE).astype(np.int64) + SHIFT


def _blocks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[np.ndarray]:
    """The fit list's vectors, up to BLOCK rows at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, BLOCK):
            yield np.frombuffer(b"".join(batch.column(0).slice(i, BLOCK).to_pylist()), np.int64).reshape(-1, length)


def fit_list(rows: DataFrame, length: int) -> DataFrame:
    """x: each distinct vector's integers, little-endian."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = integers(batch.column(0), length)
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in x], pa.binary())], ["x"])

    return rows.select("embedding").mapInArrow(read, "x binary").distinct()


@dataclass
class Totals:
    """Of the fit list: vectors, sums by dimension, and the widest range of a dimension."""

    n: int
    sums: list[int]
    width: int


def totals(fitted: DataFrame, length: int) -> Totals:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, parts = 0, np.zeros((2, length), np.int64)
        least, most = np.full(length, 2**62), np.full(length, -(2**62))
        for x in _blocks(batches, length):
            n += len(x)
            parts += [(x >> _HALF).sum(axis=0), (x & ((1 << _HALF) - 1)).sum(axis=0)]
            least, most = np.minimum(least, x.min(axis=0)), np.maximum(most, x.max(axis=0))
        if n:
            columns = [np.arange(length, dtype=np.int32), np.full(length, n), parts[0], parts[1], least, most]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["i", "n", "high", "low", "least", "most"])

    told = fitted.mapInArrow(read, "i int, n long, high long, low long, least long, most long")
    found = told.groupBy("i").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"), F.min("least").alias("least"), F.max("most").alias("most")).orderBy("i").collect()
    if not found:
        return Totals(0, [0] * length, 0)
    return Totals(found[0]["n"], [(r["high"] << _HALF) + r["low"] for r in found], max(r["most"] - r["least"] for r in found))


def scatter(fitted: DataFrame, length: int, known: Totals) -> list[list[int]]:
    """The exact sum over the fit list of y times y transposed, y = n * x - S."""
    moduli = primes(2 * known.n**3 * known.width**2)
    n, sums = known.n, known.sums
    upper = np.triu_indices(length)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((len(moduli), length, length), np.int64)
        some = False
        for x in _blocks(batches, length):
            some = True
            for k, p in enumerate(moduli):
                centred = ((x % p) * (n % p) - np.array([s % p for s in sums])) % p
                y = centred.astype(np.float64)
                found[k] = (found[k] + (y.T @ y).astype(np.int64)) % p
        if some:
            for k in range(len(moduli)):
                columns = [np.full(len(upper[0]), k, np.int32), *(u.astype(np.int32) for u in upper), found[k][upper]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["k", "i", "j", "residue"])

    told = fitted.mapInArrow(read, "k int, i int, j int, residue long").groupBy("k", "i", "j").agg(F.sum("residue").alias("residue")).collect()
    residues = np.zeros((length, length, len(moduli)), np.int64)
    for r in told:
        residues[r["i"], r["j"], r["k"]] = r["residue"] % moduli[r["k"]]
    whole = [[0] * length for _ in range(length)]
    for i, j in zip(*upper):
        whole[i][j] = whole[j][i] = remaindered(residues[i, j].tolist(), moduli)
    return whole


@dataclass
class Whitener:
    n: int
    sums: list[int]
    width: int
    #: Of each component the variance (0: none), its share, and the column that projects and divides by its deviation.
    variances: np.ndarray
    explained: list[float | None]
    axes: np.ndarray
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, from the integers' difference to S div n."""
        whole, rest = zip(*(divmod(s, self.n) for s in self.sums)) if self.sums else ((), ())
        return (x - np.array(whole, np.int64)).astype(np.float64) - np.array([r / self.n for r in rest])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.axes

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The exact sum over dimensions of (n * x - S) ** 2, None beyond a long."""
        if len(self.sums) * (self.n * self.width) ** 2 < 2**63 and self.n * self.width < 2**31:
            whole, rest = zip(*(divmod(s, self.n) for s in self.sums)) if self.sums else ((), ())
            y = (x - np.array(whole, np.int64)) * self.n - np.array(rest, np.int64)
            return (y * y).sum(axis=1).tolist()
        exact = (sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist())
        return [d if d < 2**63 else None for d in exact]


def decompose(exact: list[list[int]], known: Totals, most: int) -> Whitener:
    """Eigenvectors of the covariance exact / n**3, the greatest variance first."""
    covariance = np.array([[v / known.n**3 for v in row] for row in exact], np.float64).reshape(len(exact), len(exact))
    values, vectors = np.linalg.eigh(covariance) if len(exact) else (np.zeros(0), np.zeros((0, 0)))
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    trace = sum(exact[i][i] for i in range(len(exact))) / known.n**3
    least = len(exact) * np.finfo(np.float64).eps * max(values, default=0.0)
    values = np.where(values > least, values, 0.0)
    explained = [float(v) / trace if trace > 0 else None for v in values]
    axes = np.divide(vectors, np.sqrt(values), out=np.zeros_like(vectors), where=values > 0)
    return Whitener(known.n, known.sums, known.width, values, explained, axes)


def identity_error(fitted: DataFrame, length: int, whitener: Whitener) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity."""
    size = len(whitener.variances)
    rows, columns = (a.astype(np.int32) for a in np.divmod(np.arange(size * size), max(size, 1)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products, some = np.zeros(size), np.zeros((size, size)), False
        for x in _blocks(batches, length):
            z, some = whitener.whitened(x), True
            sums, products = sums + z.sum(axis=0), products + z.T @ z
        if some:
            told = [rows, columns, products.ravel(), sums[columns]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in told], ["i", "j", "product", "total"])

    told = fitted.mapInArrow(read, "i int, j int, product double, total double").groupBy("i", "j").agg(F.sum("product").alias("product"), F.sum("total").alias("total")).collect()
    products, means = np.zeros((size, size)), np.zeros(size)
    for r in told:
        products[r["i"], r["j"]] = r["product"] / whitener.n
        means[r["j"]] = r["total"] / whitener.n  # rounding only: rows are centred before they are multiplied
    varies = whitener.variances > 0
    off = np.abs(products - np.outer(means, means) - np.eye(size))[np.ix_(varies, varies)]
    return float(off.max()) if off.size else 0.0


def fit(rows: DataFrame, length: int, components: int) -> Whitener | None:
    """The whitener of ``rows`` (embedding: array<double>), None without a vector."""
    with cleared(rows.sparkSession):
        fitted = written(fit_list(rows, length), "fit-list")
        known = totals(fitted, length)
        if not known.n:
            return None
        whitener = decompose(scatter(fitted, length, known), known, components)
        whitener.identity_error = identity_error(fitted, length, whitener)
        return whitener


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(table: DataFrame, components: int = 16, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """A row for each vector that counts and each component: vec_id, component (from 1), n, deviation, whitened, explained,
    identity_error."""
    rows = table.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("embedding"))
    length = usual_length(rows, "embedding")
    whitener = fit(rows, length, components)
    if whitener is None:
        return rows.sparkSession.createDataFrame([], RESULT)
    size = len(whitener.variances)
    names = [c.split()[0] for c in RESULT.split(", ")]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = pa.array([whitener.variances[k] == 0 for k in range(size)], pa.bool_())
        for batch in batches:
            numbers, x = integers(batch.column(1), length)
            n = len(numbers)
            each = pa.array(np.repeat(np.arange(n), size))
            component = pa.array(np.tile(np.arange(size), n))
            z = np.ma.MaskedArray(whitener.whitened(x).ravel(), flat.take(component).to_numpy(zero_copy_only=False))
            columns = [
                batch.column(0).take(pa.array(numbers)).take(each),
                pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), n)),
                pa.array(np.full(n * size, whitener.n)),
                pa.array(whitener.deviations(x), pa.int64()).take(each),
                pa.array(z.data, pa.float64(), mask=np.ma.getmaskarray(z)),
                pa.array(whitener.explained, pa.float64()).take(component),
                pa.array(np.full(n * size, whitener.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(project, RESULT)
