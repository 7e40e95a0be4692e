"""Bin edges, and the columns that put a value into its bin."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BINS, MAX_MU = 10_000, 255
#: Bins of both kinds together: their table reaches the driver when it is written to a file.
MAX_CELLS = 4_000_000
#: Bins up to this number are found by a tree of comparisons, which is compiled; more of them from a guess.
_TREE = 256


@dataclass(frozen=True)
class Edges:
    """Bins [edges[i], edges[i + 1])."""

    edges: tuple[float, ...]
    step: float | None = field(default=None, compare=False)

    def __post_init__(self) -> None:
        if len(self.edges) < 2 or any(b <= a for a, b in zip(self.edges, self.edges[1:])) or not all(map(math.isfinite, self.edges)):
            raise ValueError("bin edges have to be finite and increasing")
        if self.edges[0] < 0:
            raise ValueError("bins start at 0 or above")
        if len(self) > MAX_BINS:
            raise ValueError(f"at most {MAX_BINS} bins are allowed")

    def __len__(self) -> int:
        return len(self.edges) - 1

    @classmethod
    def linear(cls, low: float, high: float, step: float) -> Edges:
        """low, low + step, ... until high is reached; the last edge may lie above high."""
        if step <= 0 or high <= low:
            raise ValueError("a bin size above 0 and a maximum above the minimum are needed")
        n = max(1, math.ceil((high - low) / step - 1e-10))
        if n > MAX_BINS:
            raise ValueError(f"at most {MAX_BINS} bins are allowed")
        return cls(tuple(low + i * step for i in range(n + 1)), step)

    @classmethod
    def logarithmic(cls, low: float, high: float, n: int) -> Edges:
        if low <= 0:
            raise ValueError("logarithmic bins start above 0")
        return cls(tuple(low * (high / low) ** (i / n) for i in range(n + 1)))

    @classmethod
    def pairs(cls, rows: list[tuple[float, float]], tolerance: float = 1e-10) -> Edges:
        """From (low, high) rows that follow each other; gaps within the tolerance are closed at their middle."""
        edges = [rows[0][0]]
        for (_, high), (low, _) in zip(rows, rows[1:]):
            if abs(high - low) > tolerance:
                raise ValueError(f"bins are not contiguous at {high} and {low}")
            edges.append((high + low) / 2)
        return cls((*edges, rows[-1][1]))

    @property
    def low(self) -> float:
        return self.edges[0]

    @property
    def high(self) -> float:
        return self.edges[-1]

    def index(self, value: Column, squared: bool) -> Column:
        """The bin of a value inside the range; squared: the value is a square, and so are the edges compared.

        Squares are compared with squares, so a pair on an edge of exact coordinates lies in the bin above it.
        """
        marks = [e * e if squared else e for e in self.edges]

        def pick(lo: int, hi: int) -> Column:
            if lo == hi:
                return F.lit(lo)
            mid = (lo + hi + 1) // 2
            return F.when(value < F.lit(marks[mid]), pick(lo, mid - 1)).otherwise(pick(mid, hi))

        if len(self) <= _TREE:
            return pick(0, len(self) - 1)
        table = F.array(*[F.lit(m) for m in marks])
        if self.step is None:
            return F.size(F.filter(table, lambda m: m <= value)) - 1
        plain = F.sqrt(value) if squared else value
        guess = F.floor((plain - self.low) / self.step).cast("int")
        guess = F.least(F.greatest(guess, F.lit(0)), F.lit(len(self) - 1))
        down = (value < F.element_at(table, guess + 1)).cast("int")
        up = ((value >= F.element_at(table, guess + 2)) & (guess < len(self) - 1)).cast("int")
        return guess - down + up


def mu_index(along2: Column, s2: Column, n: int, mu_one: bool = False) -> Column:
    """The bin of mu = sqrt(along2 / s2) in n bins of [0, 1); null for mu = 1 (mu_one: the last bin); 0 for s = 0."""
    if not 2 <= n <= MAX_MU:
        raise ValueError(f"2 to {MAX_MU} mu bins are allowed")
    q = F.floor(along2 * F.lit(float(n * n)) / F.when(s2 > 0, s2).otherwise(F.lit(1.0))).cast("int")
    inside = F.floor(F.sqrt(q.cast("double"))).cast("int")
    return F.when(s2 <= 0, F.lit(0)).when(q < n * n, inside).otherwise(F.lit(n - 1) if mu_one else F.lit(None).cast("int"))


@dataclass(frozen=True)
class Binning:
    """What pairs are sorted by: iso (s), smu (s and mu) or spi (s across, pi along the line of sight)."""

    scheme: str
    s: Edges
    n_mu: int | None = None
    pi: Edges | None = None
    mu_one: bool = False

    def __post_init__(self) -> None:
        if self.scheme not in ("iso", "smu", "spi"):
            raise ValueError(f"unknown binning scheme {self.scheme!r}")
        if self.scheme == "smu" and not (self.n_mu and 2 <= self.n_mu <= MAX_MU):
            raise ValueError(f"smu needs 2 to {MAX_MU} mu bins")
        if self.scheme == "spi" and self.pi is None:
            raise ValueError("spi needs bins of pi")

    @property
    def second(self) -> int:
        """Bins of the second kind (1 for iso)."""
        return {"iso": 1, "smu": self.n_mu or 1, "spi": len(self.pi) if self.pi else 1}[self.scheme]

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per bin, second kind slowest: s_idx, j_idx, s_min, s_max, s_cen, and j_min, j_max (null for iso)."""
        if len(self.s) * self.second > MAX_CELLS:
            raise ValueError(f"at most {MAX_CELLS} bins in all are allowed")
        edges = F.array(*[F.lit(float(e)) for e in self.s.edges])
        at = lambda table, i, more: F.element_at(table, (F.col(i) + (1 + more)).cast("int"))
        place = spark.range(len(self.s) * self.second).select((F.col("id") % len(self.s)).cast("int").alias("s_idx"), F.floor(F.col("id") / len(self.s)).cast("int").alias("j_idx"))
        both = place.select("s_idx", "j_idx", at(edges, "s_idx", 0).alias("s_min"), at(edges, "s_idx", 1).alias("s_max"))
        if self.scheme == "smu":
            low, high = F.col("j_idx") / F.lit(float(self.n_mu)), (F.col("j_idx") + 1) / F.lit(float(self.n_mu))
        elif self.scheme == "spi":
            marks = F.array(*[F.lit(float(e)) for e in self.pi.edges])
            low, high = at(marks, "j_idx", 0), at(marks, "j_idx", 1)
        else:
            low = high = F.lit(None).cast("double")
        both = both.withColumn("j_min", low).withColumn("j_max", high)
        return both.select("s_idx", "j_idx", "s_min", "s_max", ((F.col("s_min") + F.col("s_max")) / 2).alias("s_cen"), "j_min", "j_max")
