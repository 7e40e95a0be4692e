"""Sky positions and redshifts to comoving cartesian positions, in Mpc/h."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Speed of light over 100 km/s/Mpc.
HUBBLE_DISTANCE = 2997.92458
SAMPLES, MIN_ORDER, MAX_ORDER = 128, 4, 32


@dataclass(frozen=True)
class Cosmology:
    """Densities of matter and dark energy (default: flat) and the latter's equation of state."""

    omega_m: float
    omega_l: float | None = None
    w: float = -1.0

    def __post_init__(self) -> None:
        if not 0 < self.omega_m <= 1:
            raise ValueError("OMEGA_M has to be above 0 and at most 1")
        if self.omega_l is None:
            object.__setattr__(self, "omega_l", 1 - self.omega_m)
        if self.omega_l < 0:
            raise ValueError("OMEGA_LAMBDA has to be 0 or more")
        if self.w > -1 / 3:
            raise ValueError("DE_EOS_W has to be at most -1/3")
        z = np.linspace(0, 1100, 4001)
        if (self._squared(z) <= 0).any():
            raise ValueError("these densities give no positive H(z)^2")

    @property
    def omega_k(self) -> float:
        return 1 - self.omega_m - self.omega_l

    def _squared(self, z):
        a = 1 + z
        return self.omega_m * a**3 + self.omega_k * a**2 + self.omega_l * a ** (3 * (1 + self.w))

    def distance(self, z: np.ndarray, order: int) -> np.ndarray:
        """Comoving distance by Gauss-Legendre quadrature of the given order, on the driver."""
        node, weight = np.polynomial.legendre.leggauss(order)
        at = np.multiply.outer(np.asarray(z, float) / 2, node + 1)
        return np.asarray(z, float) / 2 * ((HUBBLE_DISTANCE / np.sqrt(self._squared(at))) @ weight)

    def order_for(self, z_min: float, z_max: float, error: float = 1e-8) -> int:
        """The order from which one more changes no distance between z_min and z_max by more than the relative error."""
        if z_min < 0:
            raise ValueError("redshifts have to be 0 or more")
        z = np.linspace(z_min, z_max, SAMPLES)
        before, need = self.distance(z, MIN_ORDER), np.zeros(len(z), int)
        for order in range(MIN_ORDER + 1, MAX_ORDER + 1):
            now = self.distance(z, order)
            need[(need == 0) & (np.abs(now - before) <= error * now)] = order
            if need.all():
                return int(need.max())
            before = now
        raise ValueError(f"orders to {MAX_ORDER} do not reach CMVDST_ERR = {error}")

    def distance_column(self, z: Column, order: int) -> Column:
        """The same quadrature as one column expression, its nodes and weights as literals."""
        node, weight = np.polynomial.legendre.leggauss(order)
        total = F.lit(0.0)
        for n, w in zip(node, weight, strict=True):
            a = z * F.lit(float((n + 1) / 2)) + 1
            squared = a * a * a * F.lit(self.omega_m) + a * a * F.lit(self.omega_k) + (F.lit(self.omega_l) if self.w == -1 else F.pow(a, F.lit(3 * (1 + self.w))) * F.lit(self.omega_l))
            total = total + F.lit(float(w) * HUBBLE_DISTANCE) / F.sqrt(squared)
        return z / 2 * total


class Spline:
    """The natural cubic spline through (z, distance) knots; outside [first, last) the distance is infinite."""

    def __init__(self, z: list[float], d: list[float]):
        order = np.argsort(np.asarray(z, float), kind="stable")
        self.z, self.d = np.asarray(z, float)[order], np.asarray(d, float)[order]
        if len(self.z) < 2 or (np.diff(self.z) <= 0).any():
            raise ValueError("a spline needs two knots or more, at different redshifts")
        h, slope = np.diff(self.z), np.diff(self.d) / np.diff(self.z)
        n = len(self.z)
        self.second = np.zeros(n)
        if n > 2:
            m = np.diag(2 * (h[:-1] + h[1:])) + np.diag(h[1:-1], 1) + np.diag(h[1:-1], -1)
            self.second[1:-1] = np.linalg.solve(m, 6 * np.diff(slope))

    def coefficients(self) -> list[tuple[float, float, float, float, float]]:
        """(z, c0, c1, c2, c3) of each piece, in powers of the distance from its left knot."""
        h, m = np.diff(self.z), self.second
        c1 = np.diff(self.d) / h - h * (2 * m[:-1] + m[1:]) / 6
        return list(zip(self.z[:-1].tolist(), self.d[:-1].tolist(), c1.tolist(), (m[:-1] / 2).tolist(), (np.diff(m) / (6 * h)).tolist(), strict=True))

    def distance_column(self, z: Column) -> Column:
        """The spline's value by a balanced tree of comparisons over its pieces."""
        pieces = self.coefficients()

        def pick(lo: int, hi: int) -> Column:
            if lo == hi:
                z0, c0, c1, c2, c3 = map(F.lit, pieces[lo])
                t = z - z0
                return c0 + t * (c1 + t * (c2 + t * c3))
            mid = (lo + hi + 1) // 2
            return F.when(z < F.lit(pieces[mid][0]), pick(lo, mid - 1)).otherwise(pick(mid, hi))

        return F.when((z >= F.lit(float(self.z[0]))) & (z < F.lit(float(self.z[-1]))), pick(0, len(pieces) - 1)).otherwise(F.lit(math.inf))


def to_cartesian(df: DataFrame, ra: str, dec: str, distance: Column) -> DataFrame:
    """Adds x, y, z from degrees and a distance; an infinite distance gives infinite or NaN positions."""
    a, d = F.radians(F.col(ra)), F.radians(F.col(dec))
    out = df.withColumn("_d", distance)
    return out.withColumns({"x": F.col("_d") * F.cos(d) * F.cos(a), "y": F.col("_d") * F.cos(d) * F.sin(a), "z": F.col("_d") * F.sin(d)}).drop("_d")


def convert(df: DataFrame, ra: str, dec: str, redshift: str, how: Cosmology | Spline, error: float = 1e-8) -> DataFrame:
    """df with comoving x, y, z. A cosmology's quadrature order is chosen once, from the table's redshift range."""
    if isinstance(how, Spline):
        return to_cartesian(df, ra, dec, how.distance_column(F.col(redshift)))
    low, high = df.agg(F.min(redshift), F.max(redshift)).first()
    if low is None:
        return to_cartesian(df, ra, dec, F.lit(None).cast("double"))
    return to_cartesian(df, ra, dec, how.distance_column(F.col(redshift), how.order_for(low, high, error)))
