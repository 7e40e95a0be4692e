"""Legendre polynomials as columns."""

from __future__ import annotations

from numpy.polynomial import legendre, polynomial
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_ORDER = 6


def polynomial_of(order: int, x: Column) -> Column:
    """P_order(x) in Horner form."""
    if not 0 <= order <= MAX_ORDER:
        raise ValueError(f"multipoles go from 0 to {MAX_ORDER}")
    power = polynomial.polytrim(legendre.leg2poly([0.0] * order + [1.0]))
    out = F.lit(float(power[-1]))
    for c in power[-2::-1]:
        out = out * x + F.lit(float(c))
    return out
