"""Column functions on vectors held as arrays."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def total(values: Column) -> Column:
    """Sum of an array, added from left to right."""
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def pnorm(a: Column, b: Column, p: float = 2, root: bool = True) -> Column:
    """Distance of two vectors in the p-norm.

    ``root=False`` leaves out the final root.  An infinite ``p`` gives the largest, a negatively
    infinite one the smallest absolute difference, whatever ``root`` says.  Null for a null vector
    or one of another length.
    """
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    if math.isinf(p):
        return F.array_max(gaps) if p > 0 else F.array_min(gaps)
    norm = total(F.transform(gaps, lambda x: x * x if p == 2 else F.pow(x, F.lit(float(p)))))
    return F.pow(norm, F.lit(1.0 / p)) if root else norm


def normalised(vector: Column, p: float = 2) -> Column:
    """The vector divided by its p-norm, or by 1e-12 where the norm is smaller."""
    values = doubles(vector)
    if math.isinf(p):
        norm = F.array_max(F.transform(values, F.abs))
    else:
        norm = F.pow(total(F.transform(values, lambda x: F.pow(F.abs(x), F.lit(float(p))))), F.lit(1.0 / p))
    # the norm is bound once: in the inner function it would be worked out for every component
    return F.transform(F.array(F.greatest(norm, F.lit(1e-12))), lambda n: F.transform(values, lambda x: x / n))[0]


def usable(vector: Column) -> Column:
    """True for a vector without null or non-finite components."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(sound & (F.size(vector) > 0), F.lit(False))


#: ln(k!) for k = 0 to 19; from there on the Stirling series is exact to the last digits.
_SMALL = [math.lgamma(k + 1) for k in range(20)]


def ln_factorial(k: Column) -> Column:
    """Natural logarithm of k!, for whole k from 0 on."""
    x = k.cast("double") + 1
    series = (x - 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3.0))) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    return F.when(k < 20, F.element_at(F.array(*[F.lit(v) for v in _SMALL]), k.cast("int") + 1)).otherwise(series)
