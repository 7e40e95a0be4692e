"""Column builders with IEEE semantics, where Spark's ANSI mode would raise or give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def divide(a: Column, b: Column) -> Column:
    """a / b of doubles: x/0 is an infinity, 0/0 NaN."""
    safe = F.when(b == 0, F.lit(1.0)).otherwise(b)
    zero = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when((b != 0) | F.isnan(b), a / safe).otherwise(zero)


def remainder(a: Column, b: Column) -> Column:
    """C's fmod: the sign is a's; NaN for a zero divisor."""
    return F.when(b == 0, F.lit(NAN)).otherwise(a % F.when(b == 0, F.lit(1.0)).otherwise(b))


def _log(f, x: Column) -> Column:
    return F.when(F.isnan(x) | (x < 0), F.lit(NAN)).when(x == 0, F.lit(-INF)).otherwise(f(x))


def ln(x: Column) -> Column:
    return _log(F.ln, x)


def log10(x: Column) -> Column:
    return _log(F.log10, x)


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < F.lit(INF))


def compare(op: str, a: Column, b: Column) -> Column:
    """A comparison of doubles in which NaN equals and precedes nothing."""
    plain = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "==": a == b, "!=": a != b}[op]
    some = F.isnan(a) | F.isnan(b)
    return some | plain if op == "!=" else ~some & plain
