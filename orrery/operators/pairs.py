"""All pairs of points within reach: as rows, by an equi-join on grid cells, or summed by bin, tile by tile of space."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators import kernel
from orrery.operators.bins import Binning, mu_index

#: Points that a block of cells should hold on average, points of either side in a tile at most, and points in a cell
#: from which cells are cut finer.
BLOCK_POINTS, TILE_POINTS, CELL_POINTS = 4_000, 100_000, 16.0


@dataclass(frozen=True)
class Box:
    """A periodic box [0, x) by [0, y) by [0, z), seen along z."""

    x: float
    y: float
    z: float

    def __post_init__(self) -> None:
        if not all(math.isfinite(s) and s > 0 for s in self.sides):
            raise ValueError("box sides have to be finite and above 0")

    @property
    def sides(self) -> tuple[float, float, float]:
        return (self.x, self.y, self.z)

    @classmethod
    def of(cls, sides: float | list[float] | tuple[float, ...]) -> Box:
        s = [sides] if isinstance(sides, int | float) else list(sides)
        if len(s) not in (1, 3):
            raise ValueError("a box has one side or three")
        return cls(*(s * 3 if len(s) == 1 else s))


def reach(binning: Binning, box: Box | None) -> tuple[float, float, float]:
    """How far apart on each axis the points of a counted pair can be."""
    if binning.scheme != "spi":
        return (binning.s.high,) * 3
    if box:
        return (binning.s.high, binning.s.high, binning.pi.high)
    return (math.hypot(binning.s.high, binning.pi.high),) * 3


@dataclass(frozen=True)
class Grid:
    """Cells of a given size; in a box whole numbers of them, elsewhere from the origin in all directions."""

    size: tuple[float, float, float]
    cells: tuple[int, int, int] | None
    spread: tuple[int, int, int]

    @classmethod
    def of(cls, far: tuple[float, float, float], box: Box | None, refine: int = 1) -> Grid:
        """Cells of the reach divided by refine, so that a pair's cells are at most refine apart on each axis."""
        if box is None:
            return cls(tuple(r / refine for r in far), None, (refine,) * 3)
        n = tuple(max(1, math.floor(side / r * refine)) for side, r in zip(box.sides, far, strict=True))
        size = tuple(side / k for side, k in zip(box.sides, n, strict=True))
        return cls(size, n, tuple(math.ceil(r / s - 1e-12) for r, s in zip(far, size, strict=True)))

    def cell(self, point: tuple[Column, Column, Column]) -> list[Column]:
        out = []
        for axis, value in enumerate(point):
            c = F.floor(value / F.lit(self.size[axis]))
            out.append(F.least(F.greatest(c, F.lit(0)), F.lit(self.cells[axis] - 1)) if self.cells else c)
        return [c.cast("long") for c in out]

    def _steps(self, axis: int) -> list[int]:
        d = range(-self.spread[axis], self.spread[axis] + 1)
        if not self.cells:
            return list(d)
        n = self.cells[axis]  # distinct cells only: in a small box steps to the left and right meet
        return sorted({(x + n // 2) % n - n // 2 for x in d})

    def offsets(self, far2: float | None) -> list[tuple[int, int, int]]:
        """Steps to the cells that can hold a partner; far2: the square of a reach that holds for the three axes together."""

        def least(axis: int, step: int) -> float:
            n = self.cells[axis] if self.cells else None
            apart = min(abs(step), n - abs(step)) if n else abs(step)
            return max(0, apart - 1) * self.size[axis]

        every = itertools.product(*(self._steps(a) for a in range(3)))
        return [o for o in every if far2 is None or sum(least(a, o[a]) ** 2 for a in range(3)) <= far2 * (1 + 1e-12)]

    def halved(self, offsets: list[tuple[int, int, int]]) -> bool:
        """Whether each offset's opposite is another one, so that half of them reach each pair of cells once."""
        return not self.cells or all(2 * self.spread[a] + 1 <= self.cells[a] for a in range(3))


def catalog(df: DataFrame, *, x: str = "x", y: str = "y", z: str = "z", w: str | None = None, id: str | None = None) -> DataFrame:
    """The columns that the pair join wants: id, x, y, z, w (1 if no weight is named; null weights are 1).

    Without an id column rows are told apart by their position, which is stable for a table that is read, not for a
    result that may be computed twice in other partitions; give an id there.
    """
    ident = F.col(id).cast("long") if id else F.monotonically_increasing_id()
    weight = F.coalesce(F.col(w).cast("double"), F.lit(1.0)) if w else F.lit(1.0)
    return df.select(ident.alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(z).cast("double").alias("z"), weight.alias("w"))


def wrapped(df: DataFrame, box: Box) -> DataFrame:
    """Positions moved into the box by whole sides."""
    return df.withColumns({a: F.col(a) - F.floor(F.col(a) / F.lit(side)) * F.lit(side) for a, side in zip("xyz", box.sides, strict=True)})


def _separation(binning: Binning, box: Box | None) -> tuple[Column, Column | None]:
    """(square of s, or of s across for spi; square of the part along the line of sight, or in a box for spi the part itself)."""
    if box:
        d = []
        for axis, side in zip("xyz", box.sides, strict=True):
            c = F.abs(F.col(f"a_{axis}") - F.col(f"b_{axis}"))
            d.append(F.least(c, F.lit(side) - c))  # of the nearest image; its sign plays no part
        if binning.scheme == "spi":
            return d[0] * d[0] + d[1] * d[1], F.abs(d[2])
        return d[0] * d[0] + d[1] * d[1] + d[2] * d[2], d[2] * d[2]
    if binning.scheme == "iso":
        d = [F.col(f"a_{a}") - F.col(f"b_{a}") for a in "xyz"]
        return d[0] * d[0] + d[1] * d[1] + d[2] * d[2], None
    total = F.col("a_r2") + F.col("b_r2")
    twice = F.lit(2.0) * (F.col("a_x") * F.col("b_x") + F.col("a_y") * F.col("b_y") + F.col("a_z") * F.col("b_z"))
    s2, difference = total - twice, F.col("a_r2") - F.col("b_r2")
    sum2 = total + twice
    along2 = F.when(sum2 > 0, difference * difference / F.when(sum2 > 0, sum2).otherwise(F.lit(1.0))).otherwise(F.lit(0.0))
    if binning.scheme == "smu":
        return s2, along2
    across2 = s2 - along2  # may come out a little below 0
    return (F.greatest(across2, F.lit(0.0)) if binning.s.low == 0 else across2), along2


def pairs(left: DataFrame, right: DataFrame | None, binning: Binning, box: Box | None = None, refine: int = 1, salt: int = 1) -> DataFrame:
    """Pairs in range with their bin: (s_idx, j_idx, w), w the product of weights; right None: each pair of left once.

    Both sides are catalog()s. Points are dealt into cells no smaller than the reach over refine; one side is
    repeated in the neighbouring cells of each point and the join is an equality of cells with the range as its
    condition, so any pair meets once and Spark shuffles, broadcasts or splits skewed cells as it sees fit. For pairs
    within one catalogue half of the neighbours do. salt > 1 deals each cell's points of the left side into as many
    parts and repeats the right side in them, for cells too dense for one task. Rows with a NaN or null position have
    no pairs.
    """
    if box and any(2 * r >= side for r, side in zip(reach(binning, box), box.sides, strict=True)):
        raise ValueError("separations have to stay below half of each side of the box")
    far = reach(binning, box)
    grid = Grid.of(far, box, refine)
    offsets = grid.offsets(None if box and binning.scheme == "spi" else far[0] ** 2)
    auto = right is None
    half = auto and grid.halved(offsets)
    if half:
        offsets = [o for o in offsets if o >= (0, 0, 0)]
    fine = ~(F.isnan("x") | F.isnan("y") | F.isnan("z"))

    def side(df: DataFrame, name: str) -> DataFrame:
        cells = grid.cell((F.col("x"), F.col("y"), F.col("z")))
        columns = [F.col(c).alias(f"{name}_{c}") for c in ("id", "x", "y", "z", "w")]
        if not box and binning.scheme != "iso":
            columns.append((F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")).alias(f"{name}_r2"))
        return df.where(fine).select(*columns, *[c.alias(f"{name}_c{i}") for i, c in enumerate(cells)])

    a, b = side(left, "a"), side(left if auto else right, "b")
    steps = F.array(*[F.struct(*[F.lit(v).alias(f"d{i}") for i, v in enumerate(o)]) for o in offsets])
    b = b.withColumn("o", F.explode(steps))
    for i in range(3):
        moved = F.col(f"b_c{i}") + F.col(f"o.d{i}")
        b = b.withColumn(f"c{i}", F.pmod(moved, F.lit(grid.cells[i]).cast("long")) if box else moved)
    b = b.withColumn("same", (F.col("o.d0") == 0) & (F.col("o.d1") == 0) & (F.col("o.d2") == 0)).drop("o", "b_c0", "b_c1", "b_c2")
    a = a.withColumnsRenamed({f"a_c{i}": f"c{i}" for i in range(3)})
    keys = ["c0", "c1", "c2"]
    if salt > 1:
        a = a.withColumn("salt", F.pmod(F.xxhash64("a_id"), F.lit(salt)))
        b = b.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salt - 1).cast("long"))))
        keys.append("salt")
    s2, along = _separation(binning, box)
    condition = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys]
    joined = a.alias("l").join(b.alias("r"), condition)
    if auto:
        joined = joined.where((~F.col("same") | (F.col("a_id") < F.col("b_id"))) if half else (F.col("a_id") < F.col("b_id")))
    inside = (s2 >= F.lit(binning.s.low**2)) & (s2 < F.lit(binning.s.high**2))
    if binning.scheme == "spi":
        low, high = (binning.pi.low, binning.pi.high) if box else (binning.pi.low**2, binning.pi.high**2)
        inside = inside & (along >= F.lit(low)) & (along < F.lit(high))
    # computed once: a projection below keeps the optimizer from repeating these in every comparison of the bins
    kept = joined.where(inside).select(s2.alias("s2"), (F.lit(0.0) if along is None else along).alias("along"), (F.col("a_w") * F.col("b_w")).alias("w"))
    if binning.scheme == "smu":
        j = mu_index(F.col("along"), F.col("s2"), binning.n_mu, binning.mu_one)
    elif binning.scheme == "spi":
        j = binning.pi.index(F.col("along"), squared=not box)
    else:
        j = F.lit(0)
    # never null: else joins on these keys push a test of all that arithmetic into the range condition
    known = [F.coalesce(c.cast("int"), F.lit(-1)).alias(n) for c, n in ((binning.s.index(F.col("s2"), squared=True), "s_idx"), (j, "j_idx"))]
    return kept.select(*known, "w")


def _finite(df: DataFrame) -> DataFrame:
    """Rows whose positions are numbers (NULL and NaN are none, and the infinite ones have no partners)."""
    return df.where(" and ".join(f"abs({a}) < double('infinity')" for a in "xyz"))


def _crowding(cells: DataFrame) -> tuple[int, float]:
    """Points of a table (cells, n), and how many points the average point has in its cell."""
    n, square = cells.agg(F.sum("n"), F.sum(F.col("n") * F.col("n").cast("double"))).first()
    return n or 0, (square or 0.0) / (n or 1)


def pair_sums(left: DataFrame, right: DataFrame | None, binning: Binning, box: Box | None = None, counted: bool = True, weighted: bool = True) -> DataFrame:
    """Pairs in range by bin: (s_idx, j_idx, n long, w double), w the sum of the products of weights; empty bins are absent.

    Without counted or weighted n or w is not summed, and 0.

    Both sides are catalog()s; right None: each pair of left once. Positions outside a box are moved into it. Space is
    cut into cells no smaller than the reach and these into blocks of cells. A point goes to its own block as a first
    point, and as a partner to the few blocks that hold a neighbour of its cell (for pairs within one catalogue those
    on one side, so that no pair meets twice): each row is copied two or three times, not once for each neighbour, and
    one exchange deals them out. A task compares the points of a block cell by cell on arrays and returns sums by bin.

    Block counts are taken first. Where a block is crowded its points are dealt by a hash of their ids into tiles of
    TILE_POINTS first points and as many partners, which meet tile by tile, so no task holds a crowded place; and
    cells are cut finer where the average point has many in its own. Pairs that nothing tells apart have to be
    compared one by one: a place of m points within one reach costs m * m comparisons, over any number of tasks.
    """
    if box and any(2 * r >= side for r, side in zip(reach(binning, box), box.sides, strict=True)):
        raise ValueError("separations have to stay below half of each side of the box")
    far, auto = reach(binning, box), right is None
    left = _finite(wrapped(left, box) if box else left)
    right = left if auto else _finite(wrapped(right, box) if box else right)
    coarse = Grid.of(far, box, 1)
    names = ["c0", "c1", "c2"]

    def occupied(df: DataFrame, grid: Grid) -> DataFrame:
        return df.select(*[c.alias(n) for n, c in zip(names, grid.cell((F.col("x"), F.col("y"), F.col("z"))), strict=True)]).groupBy(*names).agg(F.count("*").alias("n"))

    cells = occupied(left, coarse).persist()
    others = cells if auto else occupied(right, coarse).persist()
    try:
        n, crowd = _crowding(cells)
        # the fastest comparison of whole coordinates (kernel.exact_matrices) wants more points in a cell
        wanted = CELL_POINTS * (2 if binning.scheme == "iso" or (box and binning.scheme == "smu") else 1)
        refine = max(1, min(4, round((max(crowd, _crowding(others)[1]) / wanted) ** (1 / 3))))
        # a block's partners lie in a shell around it, so larger blocks have fewer copies of them: where there are many
        # points, blocks are larger, and still many enough for the machines
        held = max(BLOCK_POINTS, min(8 * BLOCK_POINTS, n / 64))
        per = max(1, round((held / max(1.0, crowd)) ** (1 / 3)))
        block = lambda c: F.floor(F.col(c) / F.lit(per)).cast("int").alias("b" + c[1:])
        keys = ["b0", "b1", "b2"]
        most = None
        for side in (cells,) if auto else (cells, others):
            blocks = side.groupBy(*[block(c) for c in names]).agg(F.sum("n").alias("n")).where(F.col("n") > TILE_POINTS)
            most = blocks if most is None else most.union(blocks)
        most = most.groupBy(*keys).agg(F.ceil(F.max("n") / F.lit(float(TILE_POINTS))).cast("int").alias("parts")).persist()
        crowded = not most.isEmpty()
    finally:
        cells.unpersist()
        others.unpersist()

    # cells of the grid that is searched lie within those that make the blocks
    fine = Grid(tuple(s / refine for s in coarse.size), coarse.cells and tuple(c * refine for c in coarse.cells), tuple(s * refine for s in coarse.spread))
    offsets = fine.offsets(None if box and binning.scheme == "spi" else far[0] ** 2)
    half = auto and fine.halved(offsets)
    if half:
        offsets = [o for o in offsets if o >= (0, 0, 0)]
    tile = kernel.Tile(binning, box and box.sides, fine.cells, tuple(offsets), "none" if not auto else "own" if half else "all", fine.size, counted, weighted)

    def dealt(df: DataFrame, partner: bool) -> DataFrame:
        held = df.select("id", "x", "y", "z", "w", *[c.alias(n) for n, c in zip(names, fine.cell((F.col("x"), F.col("y"), F.col("z"))), strict=True)])
        if partner:
            # blocks of the cells from which a step leads here, axis by axis; a step of up to one coarse cell either way on
            # each, and as a finer step may stay in the coarse cell, the shorter steps as well
            def at(axis: int, step: int) -> Column:
                c = F.floor(F.col(names[axis]) / F.lit(refine)) - F.lit(step)
                if coarse.cells:
                    c = F.pmod(c, F.lit(coarse.cells[axis]))
                return F.floor(c / F.lit(per)).cast("int")

            for axis, key in enumerate(keys):
                ends = {-(-abs(o[axis]) // refine) * (1 if o[axis] > 0 else -1) for o in offsets}
                steps = range(min(0, *ends), max(0, *ends) + 1)
                held = held.withColumn(key, F.explode(F.array_distinct(F.array(*[at(axis, v) for v in steps]))))
            held = held.select(*keys, F.lit(True).alias("partner"), "id", "x", "y", "z", "w", *names)
        else:
            held = held.select(*[F.floor(F.col(c) / F.lit(refine * per)).cast("int").alias(k) for c, k in zip(names, keys, strict=True)], F.lit(False).alias("partner"), "id", "x", "y", "z", "w", *names)
        if not crowded:
            return held.withColumn("i", F.lit(0)).withColumn("j", F.lit(0))
        held = held.join(most, keys, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        own = F.pmod(F.xxhash64("id", F.lit(partner)), F.col("parts")).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        first, second = (every, own) if partner else (own, every)
        return held.withColumn("i", first).withColumn("j", second).drop("parts")

    kinds = pa.schema([("s_idx", pa.int32()), ("j_idx", pa.int32()), ("n", pa.int64()), ("w", pa.float64())])

    def count(table: pa.Table) -> pa.Table:
        column = lambda c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False)
        partner = column("partner")
        values = {"id": column("id"), "place": np.stack([column(c) for c in "xyz"]), "w": column("w"), "cell": np.stack([column(c) for c in names], axis=1)}
        a, b = ({k: v[:, of] if k == "place" else v[of] for k, v in values.items()} for of in (~partner, partner))
        number, weight = kernel.sums(a, b, tile)
        at = np.flatnonzero((number != 0) | (weight != 0))
        found = [at // binning.second, at % binning.second, number[at], weight[at]]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(found, kinds.types, strict=True)], schema=kinds)

    rows = dealt(left, False).union(dealt(right, True))
    found = rows.groupBy(*keys, "i", "j").applyInArrow(count, "s_idx int, j_idx int, n long, w double")
    return found.groupBy("s_idx", "j_idx").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
