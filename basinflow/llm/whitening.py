"""Whitening of embeddings by their exact covariance.

Components become whole numbers, so sums and products over the table can be exact.  The scatter matrix
(products of the components less their mean, times the number of rows) is worked out modulo several
primes: each task multiplies residues as floating-point matrices whose sums stay below 2^53, tasks'
residues are added up by Spark, and Chinese remaindering gives back whole numbers of any size.  There are
as many primes as the largest possible entry needs.  The covariance is rounded once, from the exact
quotient, and decomposed in double precision.  What reaches the driver is dims * dims numbers for each
prime, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basinflow.functions.vectors import usable

SCALE, SHIFT = 64, 1_000_000
#: Residues lie within half a prime of zero, so 8,192 products of two stay below 2^53.
BLOCK, PRIME_BITS = 8192, 21
#: Largest magnitude of a whole number; larger components count as this.
MOST = 1 << 53


def primes_below(limit: int) -> Iterator[int]:
    """Primes from ``limit`` down."""
    for n in range(limit - 1, 2, -1):
        if all(n % k for k in range(2, int(n**0.5) + 1)):
            yield n


def enough_primes(bound: int) -> list[int]:
    """Primes whose product is more than twice ``bound``, so that residues tell apart -bound to bound."""
    found, product = [], 1
    for prime in primes_below(1 << PRIME_BITS):
        if product > 2 * bound:
            break
        found.append(prime)
        product *= prime
    return found


def from_residues(residues: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The whole numbers nearest to zero with the given residues, by Chinese remaindering (as Python integers)."""
    value, product = residues[0].astype(object) % primes[0], primes[0]
    for rest, prime in zip(residues[1:], primes[1:], strict=True):
        step = (rest.astype(object) - value) * pow(product, -1, prime) % prime
        value, product = value + product * step, product * prime
    return np.where(value > product // 2, value - product, value)


def whole(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of whole numbers: floor(SCALE * c) + SHIFT of every component."""
    values = np.floor(SCALE * column.flatten().to_numpy().reshape(len(column), dims).astype(float))
    return np.clip(values, -MOST, MOST).astype(np.int64) + SHIFT


def signed(x: np.ndarray, prime: int) -> np.ndarray:
    """Residues between minus and plus half a prime, as floating-point numbers."""
    r = x % prime
    return np.where(r > prime // 2, r - prime, r).astype(float)


@dataclass(frozen=True)
class Whitening:
    """``rows``, exact ``sums`` and ``ranges`` of each dimension, and the eigenvectors (columns, by falling
    eigenvalue) of the covariance with their ``values``; ``trace`` is the sum of all eigenvalues.  ``error`` is the
    largest entry of the whitened rows' covariance less the identity, over the directions that vary."""

    rows: int
    sums: tuple[int, ...]
    ranges: tuple[tuple[int, int], ...]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    error: float = 0.0

    @property
    def dims(self) -> int:
        return len(self.sums)

    @property
    def widest(self) -> int:
        """The largest magnitude of a component less its mean, times the number of rows."""
        return max((max(abs(self.rows * x - s) for x in lohi) for s, lohi in zip(self.sums, self.ranges, strict=True)), default=0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``rows * x - sums``, exactly: 64-bit where that holds them, else Python integers."""
        kind = np.int64 if self.rows * 2 * MOST < 2**62 or self.rows * max((max(map(abs, r)) for r in self.ranges), default=0) < 2**62 else object
        return x.astype(kind) * self.rows - np.array(self.sums, dtype=kind)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Coordinates on the eigenvectors over the root of their eigenvalues; NaN where nothing varies."""
        with np.errstate(invalid="ignore", divide="ignore"):
            out = (self.centred(x).astype(float) / self.rows) @ self.vectors / np.sqrt(self.values)
        return np.where(self.values > 0, out, np.nan)


SUMS = "dims int, at int, n long, high long, low long, least long, most long"


def _sum_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number, sum (in two halves, neither of which can overflow), least and largest value of each dimension."""
    held: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        sizes = batch.column(0).to_numpy()
        for dims in np.unique(sizes).tolist():
            x = whole(batch.column(1).filter(pa.array(sizes == dims)), dims)
            new = [np.full(dims, len(x)), (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0), x.min(axis=0), x.max(axis=0)]
            old = held.get(dims)
            held[dims] = new if old is None else [*(a + b for a, b in zip(old[:3], new[:3], strict=True)), np.minimum(old[3], new[3]), np.maximum(old[4], new[4])]
    for dims, parts in held.items():
        head = [pa.array(np.full(dims, dims, dtype=np.int32)), pa.array(np.arange(dims, dtype=np.int32))]
        yield pa.RecordBatch.from_arrays([*head, *(pa.array(p) for p in parts)], names=["dims", "at", "n", "high", "low", "least", "most"])


def usable_rows(x: DataFrame, vector_col: str, *kept: Column) -> DataFrame:
    """``dims, vec`` (double) and the ``kept`` columns of the rows whose vector can be used."""
    return x.where(usable(F.col(vector_col))).select(F.size(vector_col).alias("dims"), F.col(vector_col).cast("array<double>").alias("vec"), *kept)


def _scatter_batches(batches: Iterator[pa.RecordBatch], model: Whitening, primes: list[int]) -> Iterator[pa.RecordBatch]:
    """Residues of the scatter of a task's rows: one row for each prime and dimension, from the diagonal on."""
    total = [np.zeros((model.dims, model.dims), dtype=np.int64) for _ in primes]
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            rows = whole(batch.column(0).slice(at, BLOCK), model.dims)
            for held, prime in zip(total, primes, strict=True):
                centred = (rows % prime) * (model.rows % prime) - np.array([s % prime for s in model.sums])
                r = signed(centred, prime)
                held += (r.T @ r).astype(np.int64) % prime
    for number, held in enumerate(total):
        held %= primes[number]
        for i in range(model.dims):
            yield pa.RecordBatch.from_arrays([pa.array([number], type=pa.int32()), pa.array([i], type=pa.int32()), pa.array([held[i, i:]], type=pa.list_(pa.int64()))], names=["prime", "i", "residues"])


def exact_scatter(rows: DataFrame, model: Whitening) -> np.ndarray:
    """Sum over ``rows(vec)`` of (rows * x - sums) times itself transposed, as Python integers."""
    primes = enough_primes(max(1, model.rows * model.widest**2))
    parts = rows.mapInArrow(lambda b: _scatter_batches(b, model, primes), "prime int, i int, residues array<long>")
    each = parts.select("prime", "i", F.posexplode("residues").alias("k", "r")).groupBy("prime", "i", (F.col("i") + F.col("k")).alias("j"))
    found = each.agg(F.sum("r").alias("r")).toArrow()  # dims * (dims + 1) / 2 numbers for each prime
    residues = [np.zeros((model.dims, model.dims), dtype=np.int64) for _ in primes]
    number, i, j, r = (found.column(c).to_numpy() for c in ("prime", "i", "j", "r"))
    for k, (held, prime) in enumerate(zip(residues, primes, strict=True)):
        mine = number == k
        held[i[mine], j[mine]] = held[j[mine], i[mine]] = r[mine] % prime
    return from_residues(residues, primes)


def _moment_batches(batches: Iterator[pa.RecordBatch], model: Whitening) -> Iterator[pa.RecordBatch]:
    """Sums of a task's whitened rows and of their products: rows ``i, values`` of a matrix bordered by the sums."""
    k = len(model.values)
    total = np.zeros((k + 1, k + 1))
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            w = np.nan_to_num(model.whiten(whole(batch.column(0).slice(at, BLOCK), model.dims)))
            w = np.hstack([w, np.ones((len(w), 1))])
            total += w.T @ w
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + 1, dtype=np.int32)), pa.array(list(total), type=pa.list_(pa.float64()))], names=["i", "values"])


def measured_error(rows: DataFrame, model: Whitening) -> float:
    """Largest entry of the covariance of the whitened rows less the identity, where there is variation.

    Whitened rows are centred as they are made (their mean is zero but for rounding, and is taken off)."""
    parts = rows.mapInArrow(lambda b: _moment_batches(b, model), "i int, values array<double>")
    found = parts.select("i", F.posexplode("values").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).toArrow()
    k = len(model.values)
    total = np.zeros((k + 1, k + 1))
    total[found.column("i").to_numpy(), found.column("j").to_numpy()] = found.column("x").to_numpy()
    mean = total[:k, k] / model.rows
    gap = total[:k, :k] / model.rows - np.outer(mean, mean) - np.eye(k)
    varying = model.values > 0
    return float(np.abs(gap[np.ix_(varying, varying)]).max(initial=0.0))


def fit(x: DataFrame, components: int = 32, vector_col: str = "embedding") -> Whitening | None:
    """The whitening of all usable vectors of ``x``, or None where there is none.

    Vectors that are null, empty or hold null or non-finite components take no part.  Vectors must have one
    length: where they do not, those of the commonest length count (the longest of equally common ones)
    and the others take no part.  Repeated rows count each.  Components beyond 2^53 / 64 count as that.
    Eigenvalues within rounding of zero (10^-12 of the trace) are set to zero.
    """
    sums = usable_rows(x, vector_col).mapInArrow(_sum_batches, SUMS).groupBy("dims", "at")
    halves = [F.sum(F.col(c).cast("decimal(38, 0)")).alias(c) for c in ("high", "low")]
    per_dim = sums.agg(F.sum("n").alias("n"), *halves, F.min("least").alias("least"), F.max("most").alias("most"))
    commonest = per_dim.where("at = 0").orderBy(F.desc("n"), F.desc("dims")).limit(1).select("dims")
    found = per_dim.join(F.broadcast(commonest), "dims").orderBy("at").collect()  # a row for each dimension
    if not found:
        return None
    model = Whitening(found[0]["n"], tuple((int(r["high"]) << 32) + int(r["low"]) for r in found), tuple((r["least"], r["most"]) for r in found), np.zeros((len(found), 0)), np.zeros(0), 0.0)
    rows = usable_rows(x, vector_col).where(F.col("dims") == model.dims).select("vec")
    scatter, divisor = exact_scatter(rows, model), model.rows**3
    covariance = np.array([[int(c) / divisor for c in row] for row in scatter], dtype=float).reshape(model.dims, model.dims)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    trace = float(np.trace(covariance))
    model = Whitening(model.rows, model.sums, model.ranges, vectors, np.where(values > 1e-12 * trace, values, 0.0), trace)
    return Whitening(model.rows, model.sums, model.ranges, vectors, model.values, trace, measured_error(rows, model))


def _whiten_batches(batches: Iterator[pa.RecordBatch], model: Whitening) -> Iterator[pa.RecordBatch]:
    count = len(model.values)
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            some = batch.slice(at, BLOCK)
            x = whole(some.column(0), model.dims)
            kind = np.int64 if model.dims * model.widest**2 < 2**63 else object
            far = (model.centred(x).astype(kind) ** 2).sum(axis=1).tolist()
            values = pa.array(model.whiten(x).ravel(), from_pandas=True)  # NaN: null
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * count), values)
            yield pa.RecordBatch.from_arrays([some.column(1), pa.array([str(v) for v in far]), lists], names=["id", "deviation", "whitened"])


def transform(x: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id_col, deviation`` (squared distance to the mean times rows squared, exact decimal digits) and
    ``whitened`` (one value for each component, null where nothing varies) of every vector that fits the model."""
    kind = x.schema[id_col].dataType.simpleString()
    rows = usable_rows(x, vector_col, F.col(id_col).alias("id")).where(F.col("dims") == model.dims).select("vec", "id")
    return rows.mapInArrow(lambda b: _whiten_batches(b, model), f"id {kind}, deviation string, whitened array<double>").withColumnRenamed("id", id_col)


def components_of(x: DataFrame, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id_col, component, n, deviation, whitened, explained, identity_error``: a row for each usable vector and
    component (numbered from 1), fitted on all of them.

    ``deviation`` is null where it does not fit 64 bits, ``whitened`` where the component has no variance,
    ``explained`` where nothing varies.  An empty table, or one without usable vectors, gives no rows; rows
    without an id and repeated rows are kept; other columns are ignored.  See :func:`fit` for what is usable.
    """
    spark, kind = x.sparkSession, x.schema[id_col].dataType.simpleString()
    model = fit(x, components, vector_col)
    if model is None:
        return spark.createDataFrame([], f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    shares = F.array(*[F.lit(float(v) / model.trace if model.trace else None).cast("double") for v in model.values])
    rows = transform(x, model, id_col, vector_col).select(F.col(id_col), F.expr("try_cast(deviation as long)").alias("deviation"), F.posexplode("whitened").alias("k", "whitened"))
    return rows.select(id_col, (F.col("k") + 1).alias("component"), F.lit(model.rows).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("k")).alias("explained"), F.lit(model.error).alias("identity_error"))
