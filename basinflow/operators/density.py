"""Densities from the distance to the empirical measure, as aggregations over ``knn(i, rk, j, dist)``.

Distances are used as they stand; with the default search they are squared.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basinflow.operators.knn import Knn, knn_exact


def dtm(knn: DataFrame, q: float = 2) -> DataFrame:
    """``i, dtm``: the q-th root of the mean distance, which is expected to be powered already."""
    return knn.groupBy("i").agg(F.pow(F.avg("dist"), F.lit(1.0 / q)).alias("dtm"))


def dtm_of_points(x: DataFrame, spec: Knn, q: float = 2) -> DataFrame:
    """:func:`dtm` of a table of points by the exact search."""
    return dtm(knn_exact(x, spec), q)


def density_of_points(x: DataFrame, spec: Knn, dim: int, q: float | None = None, normalize: bool = False) -> DataFrame:
    """:func:`dtm_density` of a table of points by the exact search."""
    n = x.count() if normalize else None
    return dtm_density(knn_exact(x, spec), dim, q, normalize, k=spec.k if normalize else None, n=n)


def _measure(q: float, k: int | None, weights: Sequence[float] | None) -> Column:
    """Weighted sum of the q-th powers; without weights each of the k neighbours has 1/k."""
    power = F.pow("dist", F.lit(float(q)))
    if weights is not None:
        return F.sum(power * F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("rk")))
    return F.sum(power) / F.lit(k) if k else F.avg(power)


def dtm_density(knn: DataFrame, dim: int, q: float | None = None, normalize: bool = False, weights: Sequence[float] | None = None, k: int | None = None, n: int | None = None) -> DataFrame:
    """``i, f``: density ``measure ** (-dim / q)``; ``q`` defaults to ``dim``.

    ``weights`` (one per rank) should sum to 1; lists shorter than ``k`` count their own length unless
    ``k`` is given.  ``normalize`` scales to a probability density and needs ``k`` and the number of
    points ``n``.  Coinciding neighbours (a measure of 0) give infinity.
    """
    q = dim if q is None else q
    measure = _measure(q, k, weights)
    if normalize:
        if k is None or n is None:
            raise ValueError("a normalised density needs k and n")
        each = [1.0 / k] * k if weights is None else list(weights)
        scale = math.fsum(w * r ** (q / dim) for r, w in enumerate(each, 1))
        ball = math.pi ** (dim / 2) / math.gamma(dim / 2 + 1)
        return knn.groupBy("i").agg((_power(measure / F.lit(scale), -dim / q) / F.lit(n * ball)).alias("f"))
    return knn.groupBy("i").agg(_power(measure, -dim / q).alias("f"))


def _power(measure: Column, exponent: float) -> Column:
    return F.when(measure == 0, F.lit(float("inf"))).otherwise(F.pow(measure, F.lit(exponent)))


def log_density(knn: DataFrame, dim: int, q: float | None = None, weights: Sequence[float] | None = None, k: int | None = None) -> DataFrame:
    """``i, f``: logarithm of :func:`dtm_density`, worked out without leaving log space.

    A measure of 0 gives infinity; a density that is no number is an error.
    """
    q = dim if q is None else q
    measure = _measure(q, k, weights)
    log = F.when(measure == 0, F.lit(float("inf"))).otherwise(F.lit(-dim / q) * F.ln(measure))
    return checked(knn.groupBy("i").agg(log.alias("f")))


def checked(density: DataFrame) -> DataFrame:
    """``density(i, f)``, failing on a density that is null or not a number."""
    bad = F.col("f").isNull() | F.isnan("f")
    return density.withColumn("f", F.when(bad, F.raise_error(F.lit("density is not a number")).cast("double")).otherwise(F.col("f").cast("double")))
