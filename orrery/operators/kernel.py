"""Pair sums of the points of one tile, by numpy alone: what each task of the pair counts does."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np

from orrery.operators.bins import Binning

#: Candidate pairs that are looked at together.
CHUNK = 1 << 20
#: Candidate pairs of one cell from which it is compared with its partners as a matrix, and those of a piece of it, whose
#: arrays stay in a core's cache.
MATRIX, PIECE = 2_048, 1 << 16
#: Steps of a table of bins at most, and those of a table of bins by two whole numbers.
STEPS, CODES = 1 << 16, 1 << 21
#: Edges up to which pairs are counted below each of them, which costs less than to look up the bin of each pair.
MARKS = 17
#: Products of weights up to which pairs are counted by them, instead of summing a weight for each pair.
PRODUCTS = 16
#: Bins of pairs that are gathered before they are counted.
GATHERED = 1 << 20


def runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for size[0] numbers, then the same from start[1], and so on."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


@dataclass(frozen=True)
class Tile:
    """How a tile's points are compared.

    sides: of the periodic box, or None. cells: how many it has on each axis, or None. offsets: steps from a point's
    cell to those that hold its partners. order: pairs count where the first id is smaller: in no cell (two
    catalogues), in the point's own cell, or in all cells. size: of a cell on each axis. counted, weighted: whether
    pairs are counted, and whether their weights are summed.
    """

    binning: Binning
    sides: tuple[float, float, float] | None
    cells: tuple[int, int, int] | None
    offsets: tuple[tuple[int, int, int], ...]
    order: str
    size: tuple[float, float, float]
    counted: bool = True
    weighted: bool = True


class Steps:
    """The bins of values by a table, exactly: where a power of two makes all edges whole, the values times it, rounded
    down, lie on one side of each edge. Elsewhere (table None) by search."""

    def __init__(self, marks: list[float]):
        self.marks, self.table, self.none = np.array(marks), None, len(marks) - 1
        for power in range(0, 41):
            edges = self.marks * 2.0**power
            if edges[-1] >= STEPS:
                break
            if (edges == np.floor(edges)).all():
                self.scale, self.top = 2.0**power, int(edges[-1])
                self.table = np.searchsorted(edges, np.arange(self.top + 1), "right") - 1
                self.table[self.table < 0] = self.none
                break

    def step(self, values: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Places in the table (no table: bins, none for values out of range); negative values are out of range. values is overwritten."""
        negative = None if values.min() >= 0 else ~(values >= 0)  # or no number
        if self.table is None:
            out[...] = np.searchsorted(self.marks, values, "right") - 1
            out[out < 0] = self.none
        else:
            if self.scale != 1.0:
                np.multiply(values, self.scale, out=values)
            np.minimum(values, self.top, out=values)
            np.copyto(out, values, casting="unsafe")
        if negative is not None:
            out[negative] = self.none if self.table is None else self.top
        return out

    def bins(self, values: np.ndarray, out: np.ndarray) -> np.ndarray:
        found = self.step(values, out)
        return found if self.table is None else np.take(self.table, found, out=found, mode="clip")


class Matrix:
    """Sums by bin of the pairs of some points with some others, all with all: the same arithmetic as `separation` and
    `bins_of`, operation by operation, on arrays that stay in the cache."""

    def __init__(self, tile: Tile):
        self.tile, b = tile, tile.binning
        self.periodic, self.scheme = tile.sides is not None, b.scheme
        self.s = Steps([e * e for e in b.s.edges])
        self.j = Steps([e if self.periodic else e * e for e in b.pi.edges]) if b.scheme == "spi" else None
        if b.scheme == "smu":
            n = b.n_mu
            self.rows = n + 1
            self.mu = np.minimum(np.sqrt(np.arange(n * n + 1)).astype(np.int64), n - 1 if b.mu_one else n)
        else:
            self.rows = b.second + 1 if b.scheme == "spi" else 1
        self.marks = self.s.marks.tolist() if b.scheme == "iso" and len(b.s) < MARKS else None
        plain = b.scheme == "iso" and self.s.table is not None and not self.marks
        self.cells = self.s.top + 1 if plain else (len(b.s) + 1) * self.rows
        self.weight, self.plain = np.zeros(self.cells), plain
        self.parts: dict[float, np.ndarray] = {}  # pairs by the product of their weights, where few products occur
        self.grouped = False
        self.codes = self._codes() if b.scheme == "smu" and self.periodic else None
        self.gathered: dict[float, tuple[np.ndarray, int]] = {}
        self.floats = {t: np.empty((5, PIECE), t) for t in (np.float32, np.float64)}
        self.ints, self.near = np.empty((2, PIECE), np.int64), np.empty(PIECE, bool)
        # whole numbers below 2 ** 24, and the floors of their quotients, are exact in single precision
        self.single = (self.s.table is not None and self.s.top <= 1 << 24) and b.scheme != "spi" and (b.n_mu or 1) ** 2 * b.s.high**2 < 1 << 24

    def _codes(self) -> np.ndarray | None:
        """Bins (255 for none) of pairs with whole coordinates by s^2 * span + the part along the line
        of sight + half of span; the last place stands for all that are farther."""
        b = self.tile.binning
        far = math.ceil(b.s.high)
        self.half, self.span = far, 2 * far + 1
        top = math.ceil(b.s.high**2)
        if top * self.span > CODES or len(b.s) * b.second >= 255:
            return None
        s2, along = (x.ravel() for x in np.divmod(np.arange(top * self.span), self.span))
        at, found = bins_of(s2.astype(float), (along - self.half).astype(float) ** 2, b, True)
        table = np.full(top * self.span + 1, 255, np.uint8)
        table[at] = found
        return table

    def exact(self, left: np.ndarray, right: np.ndarray, groups: list[tuple[slice, float]]) -> None:
        """Adds the pairs of factors (see `factors`), all with all: their product gives s^2, or the codes of pairs."""
        kind, wide = left.dtype.type, max(1, PIECE // len(left))
        for at in range(0, len(right), wide):
            part = right[at : at + wide]
            shape = len(left), len(part)
            found = np.matmul(left, part.T, out=self.floats[kind][0][: shape[0] * shape[1]].reshape(shape))
            if self.codes is None:
                self._below(found, groups)
                continue
            place = self.ints[0][: found.size].reshape(shape)
            np.copyto(place, found, casting="unsafe")
            for rows, product in groups:
                held, n_held = self.gathered.get(product) or (np.empty(GATHERED, np.uint8), 0)
                one = place[rows]
                if n_held + one.size > GATHERED:
                    self._flush(product, held[:n_held])
                    n_held = 0
                np.take(self.codes, one, out=held[n_held : n_held + one.size].reshape(one.shape), mode="clip")
                self.gathered[product] = held, n_held + one.size

    def factors(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Factors of points with whole coordinates a, b (rows x, y, z from a common origin), a row for each point; None
        if their products would not be exact, or if the scheme does not go by them."""
        times = 1.0 if self.codes is None else float(self.span)
        most = max(np.abs(a).max(), np.abs(b).max(), 1.0)
        # terms and their sums stay below 2 ** 24, or 2 ** 53: 3 (|a| + |b|)^2 times the span, and the part along
        largest = 12 * most * most * times + 2 * most + times
        if (not self.marks and self.codes is None) or largest >= 1 << 53:
            return None
        kind = np.float32 if largest < 1 << 24 and (self.codes is not None or self.single) else np.float64
        more = (a[2] + self.half, -b[2]) if self.codes is not None else (0.0, 0.0)
        left = np.stack([*(a * (-2.0 * times)), (a * a).sum(axis=0) * times + more[0], np.ones(a.shape[1])], axis=1)
        right = np.stack([*b, np.ones(b.shape[1]), (b * b).sum(axis=0) * times + more[1]], axis=1)
        return left.astype(kind), right.astype(kind)

    def _flush(self, product: float, held: np.ndarray) -> None:
        """Counts gathered bins, two at a time."""
        b = self.tile.binning
        found = np.bincount(held[: len(held) // 2 * 2].view(np.uint16), minlength=1 << 16).reshape(256, 256)
        found = found.sum(axis=0) + found.sum(axis=1)
        if len(held) % 2:
            found[held[-1]] += 1
        self._part(product).reshape(len(b.s) + 1, self.rows)[: len(b.s), : b.second] += found[: len(b.s) * b.second].reshape(len(b.s), b.second)

    def _part(self, product: float) -> np.ndarray:
        return self.parts.setdefault(product, np.zeros(self.cells, np.int64))

    def whole(self, a: np.ndarray, b: np.ndarray, wa: np.ndarray, wb: np.ndarray, groups: list[tuple[slice, float]]) -> None:
        """a, b: rows x, y, z of whole numbers, without a nearer image. Sums of their products are exact in any order, so
        that squares of separations are one product of matrices: |a|^2 + |b|^2 - 2 ab."""
        origin = a.min(axis=1, keepdims=True)
        p, q = a - origin, b - origin
        sighted = self.tile.sides is None and self.scheme != "iso"
        kind = np.float32 if self.single and not sighted and max(p.max(), np.abs(q).max()) < 1000 else np.float64
        n = float(self.tile.binning.n_mu or 1)

        def factors(p: np.ndarray, q: np.ndarray, twice: float) -> tuple[np.ndarray, np.ndarray]:
            left = np.stack([*(p * twice), (p * p).sum(axis=0), np.ones(p.shape[1])], axis=1).astype(kind)
            return left, np.stack([*q, np.ones(q.shape[1]), (q * q).sum(axis=0)]).astype(kind)

        left, right = factors(p, q, -2.0)
        if sighted:
            left_sum, right_sum = factors(a, b, 2.0)
            a2, b2 = (a * a).sum(axis=0)[:, None], (b * b).sum(axis=0)[None, :]
        deep, deeper = (p[2] * n).astype(kind)[:, None], (q[2] * n).astype(kind)[None, :]
        wide = PIECE // len(wa)
        for at in range(0, len(wb), wide):
            part = slice(at, at + wide)
            s2, u, v, along, shape = self._room(len(wa), len(wb[part]), kind)
            np.matmul(left, right[:, part], out=s2)
            if sighted:
                np.subtract(a2, b2[:, part], out=u)
                np.multiply(u, u, out=u)
                np.matmul(left_sum, right_sum[:, part], out=v)
                self._shared(u, v, along)
                if self.scheme == "spi":
                    self._across(s2, along)
                else:
                    np.multiply(along, n * n, out=along)
            elif self.scheme == "smu":
                np.subtract(deep, deeper[:, part], out=along)
                np.multiply(along, along, out=along)
            elif self.scheme == "spi":
                np.subtract(deep, deeper[:, part], out=along)
                np.abs(along, out=along)
                np.subtract(p[2][:, None], q[2][None, part], out=u)
                np.multiply(u, u, out=u)
                np.subtract(s2, u, out=s2)
            self._binned(s2, along, u, wa, wb[part], shape, groups)

    def _room(self, n: int, m: int, kind: type) -> tuple:
        return *(f[: n * m].reshape(n, m) for f in self.floats[kind][:4]), (n, m)

    def add(self, a: np.ndarray, b: np.ndarray, wa: np.ndarray, wb: np.ndarray, fold: tuple[bool, ...], groups: list[tuple[slice, float]]) -> None:
        """a, b: rows x, y, z and, where there is no box, the square of the distance from the origin; fold: axes on which
        the nearest image may be another one."""
        wide = PIECE // len(wa)
        for at in range(0, len(wb), wide):
            part = slice(at, at + wide)
            s2, u, v, x, shape = self._room(len(wa), len(wb[part]), np.float64)
            one, two = a[:, :, None], b[:, None, part]
            if self.periodic or self.scheme == "iso":
                along = self._straight(one, two, fold, s2, u)
            else:
                along = self._sighted(one, two, s2, u, v, x)
            if self.scheme == "smu":
                along = np.multiply(along, float(self.tile.binning.n_mu**2), out=x)
            self._binned(s2, along, v, wa, wb[part], shape, groups)

    def _binned(self, s2: np.ndarray, along: np.ndarray | None, u: np.ndarray, wa: np.ndarray, wb: np.ndarray, shape: tuple[int, int], groups: list[tuple[slice, float]]) -> None:
        """Adds pairs; along: for smu times the square of the number of mu bins; groups: rows and the product of the weights
        of their pairs, if there are few products."""
        if self.marks and (self.grouped or not self.tile.weighted):
            self._below(s2, groups)
            return
        first, second = (i[: s2.size].reshape(shape) for i in self.ints)
        if self.plain:
            at = self.s.step(s2, first)
        else:
            if self.scheme == "smu":
                n = float(self.tile.binning.n_mu**2)
                bad = None if s2.min() > 0 else ~(s2 > 0)
                if bad is None:
                    np.divide(along, s2, out=u)
                else:
                    u[...] = 0.0
                    np.divide(along, s2, out=u, where=~bad)
                np.minimum(u, n, out=u)
                np.copyto(second, u, casting="unsafe")
                np.take(self.mu, second, out=second, mode="clip")
            elif self.scheme == "spi":
                self.j.bins(along, second)
            at = self.s.bins(s2, first)
            if self.rows > 1:
                np.multiply(at, self.rows, out=at)
                np.add(at, second, out=at)
        if self.tile.counted or self.grouped:
            for rows, product in groups:
                self._part(product)[...] += np.bincount(at[rows].ravel(), minlength=self.cells)
        if self.tile.weighted and not self.grouped:
            w = self.floats[np.float64][4][: s2.size].reshape(shape)
            np.multiply(wa[:, None], wb[None, :], out=w)
            self.weight += np.bincount(at.ravel(), w.ravel(), self.cells)

    def _below(self, s2: np.ndarray, groups: list[tuple[slice, float]]) -> None:
        """Adds pairs by counting those below each edge."""
        near, below = self.near[: s2.size].reshape(s2.shape), []
        for mark in self.marks:
            np.less(s2, mark, out=near)
            below.append([np.count_nonzero(near[rows]) for rows, _ in groups])
        for (_, product), found in zip(groups, np.diff(np.array(below), axis=0).T, strict=True):
            self._part(product)[:-1] += found

    def _straight(self, a, b, fold, s2, u) -> np.ndarray | None:
        for axis in range(3):
            np.subtract(a[axis], b[axis], out=u)
            if fold[axis]:
                side = self.tile.sides[axis]
                np.abs(u, out=u)
                np.minimum(u, side - u, out=u)
            if axis == 2 and self.scheme == "spi":
                return np.abs(u, out=u)
            np.multiply(u, u, out=u if axis else s2)
            if axis:
                np.add(s2, u, out=s2)
        return u

    def _sighted(self, a, b, s2, u, v, x) -> np.ndarray:
        np.multiply(a[0], b[0], out=u)
        for axis in (1, 2):
            np.multiply(a[axis], b[axis], out=v)
            np.add(u, v, out=u)
        np.multiply(u, 2.0, out=u)
        np.add(a[3], b[3], out=v)
        np.subtract(v, u, out=s2)
        np.add(v, u, out=v)
        np.subtract(a[3], b[3], out=u)
        np.multiply(u, u, out=u)
        self._shared(u, v, x)
        if self.scheme == "spi":
            self._across(s2, x)
        return x

    @staticmethod
    def _shared(square: np.ndarray, sum2: np.ndarray, out: np.ndarray) -> None:
        """square / sum2, 0 where sum2 is not above 0."""
        none = None if sum2.min() > 0 else ~(sum2 > 0)
        if none is not None:
            sum2[none], square[none] = 1.0, 0.0
        np.divide(square, sum2, out=out)

    def _across(self, s2: np.ndarray, along2: np.ndarray) -> None:
        np.subtract(s2, along2, out=s2)
        if self.tile.binning.s.low == 0:
            np.maximum(s2, 0.0, out=s2)

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """By s_idx * bins of the second kind + j_idx."""
        b = self.tile.binning
        for product, (held, n) in self.gathered.items():
            self._flush(product, held[:n])
        self.gathered.clear()
        number, weight = np.zeros(self.cells, np.int64), self.weight
        for product, found in self.parts.items():
            number = number + found if self.tile.counted else number
            weight = weight + product * found if self.grouped else weight
        out = []
        for found in (number, weight):
            if self.plain:
                held = np.zeros(len(b.s) + 1, found.dtype)
                np.add.at(held, self.s.table, found)
                held = held[:, None]
            else:
                held = found.reshape(len(b.s) + 1, self.rows)
            out.append(held[: len(b.s), : b.second].ravel())
        return out[0], out[1]


def candidates(a_cells: np.ndarray, b_cells: np.ndarray, tile: Tile) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in a, places in b, whether of the same cell) of points in cells that are a step apart, CHUNK at a time.

    b_cells are sorted by their three columns.
    """
    low = b_cells.min(axis=0)
    extent = b_cells.max(axis=0) - low + 1
    code = lambda c: ((c[:, 0] - low[0]) * extent[1] + c[:, 1] - low[1]) * extent[2] + c[:, 2] - low[2]
    b_code = code(b_cells)
    own, of = np.unique(a_cells, axis=0, return_inverse=True)
    by = np.argsort(of.ravel(), kind="stable")
    n_a = np.bincount(of.ravel(), minlength=len(own))
    first_a = np.cumsum(n_a) - n_a
    for o in tile.offsets:
        to = own + np.array(o)
        if tile.cells:
            to %= np.array(tile.cells)
        there = ((to >= low) & (to < low + extent)).all(axis=1)
        wanted = code(np.where(there[:, None], to, low))
        begin = np.searchsorted(b_code, wanted)
        n_b = np.where(there, np.searchsorted(b_code, wanted, "right") - begin, 0)
        # one run of partners for each point of a
        start, size, place = np.repeat(begin, n_a), np.repeat(n_b, n_a), by[runs(first_a, n_a)]
        some = size > 0
        start, size, place = start[some], size[some], place[some]
        for piece in np.split(np.arange(len(size)), np.flatnonzero(np.diff(np.cumsum(size) // CHUNK)) + 1):
            if len(piece):
                yield np.repeat(place[piece], size[piece]), runs(start[piece], size[piece]), o == (0, 0, 0)


def _columns(offsets: np.ndarray) -> np.ndarray:
    """Steps (x, y, least z, greatest z) that stand for the given ones, neighbours in z taken together."""
    by = offsets[np.lexsort(offsets.T[::-1])]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(by[:, :2], axis=0) != 0).any(axis=1) | (np.diff(by[:, 2]) != 1)]))
    return np.concatenate([by[new], by[np.append(new[1:], len(by)) - 1][:, 2:]], axis=1)


def exact_matrices(a: dict[str, np.ndarray], b: dict[str, np.ndarray], tile: Tile, total: Matrix) -> np.ndarray | None:
    """What `matrices` does, for whole coordinates that lie so close together that in a box the image of a partner that is
    nearest to the middle of the points of a is nearest to each of them; None if they do not. The factors of all points
    are made once, and a cell's partners are runs of them."""
    offsets = np.array(tile.offsets)
    if not (tile.binning.scheme == "iso" or (tile.sides is not None and total.codes is not None)):
        return None
    if any((p != np.floor(p)).any() for p in (a["place"], b["place"])) or any(float(x) != int(x) for x in tile.sides or ()):
        return None
    low, high = a["place"].min(axis=1), a["place"].max(axis=1)
    middle = np.floor((low + high) / 2)
    place_a, place_b, cell_b = a["place"] - middle[:, None], b["place"] - middle[:, None], b["cell"].astype(np.int64)
    if tile.sides is not None:
        sides = np.array(tile.sides)
        if ((high - low) / 2 + tile.binning.s.high + 2 >= sides / 2).any() or (2 * np.abs(offsets).max(axis=0) + 1 > np.array(tile.cells)).any():
            return None
        images = (place_b < -sides[:, None] / 2).astype(np.int64) - (place_b >= sides[:, None] / 2)
        place_b, cell_b = place_b + images * sides[:, None], cell_b + images.T * np.array(tile.cells)
    made = total.factors(place_a, place_b)
    if made is None:
        return None
    w_a, class_a = np.unique(a["w"], return_inverse=True) if tile.weighted else (np.ones(1), np.zeros(len(a["id"]), int))
    w_b, class_b = np.unique(b["w"], return_inverse=True) if tile.weighted else (np.ones(1), np.zeros(len(b["id"]), int))
    if len(w_a) * len(w_b) > PRODUCTS or not (np.isfinite(w_a).all() and np.isfinite(w_b).all()):
        return None
    total.grouped = tile.weighted
    own, of = np.unique(a["cell"].astype(np.int64), axis=0, return_inverse=True)
    by = np.lexsort((class_a, of.ravel()))
    left, class_a = made[0][by], class_a[by]
    n_a = np.bincount(of.ravel(), minlength=len(own))
    first_a = np.cumsum(n_a) - n_a
    low, high = cell_b.min(axis=0), cell_b.max(axis=0)
    extent = high - low + 1
    code = ((cell_b[:, 0] - low[0]) * extent[1] + cell_b[:, 1] - low[1]) * extent[2] + cell_b[:, 2] - low[2]
    steps, kinds = _columns(offsets), []
    for k, w in enumerate(w_b):
        mine = np.flatnonzero(class_b == k)
        mine = mine[np.argsort(code[mine], kind="stable")]
        kinds.append((float(w), made[1][mine], place_b[:, mine], code[mine]))
    enough = np.zeros(len(own), bool)
    slab = max(1, (1 << 20) // len(steps))
    # points farther from the middle of a cell's points than the reach and the farthest of those have no pairs with them
    far = tile.binning.s.high + 1e-6
    for begin in range(0, len(own), slab):
        here = own[begin : begin + slab, None, :]
        at = [here[:, :, i] + steps[None, :, i] for i in range(2)]
        least, most = (np.clip(here[:, :, 2] + steps[None, :, i], low[2] - 1, high[2] + 1) for i in (2, 3))
        there = (at[0] >= low[0]) & (at[0] <= high[0]) & (at[1] >= low[1]) & (at[1] <= high[1]) & (most >= low[2]) & (least <= high[2])
        column = ((at[0] - low[0]) * extent[1] + at[1] - low[1]) * extent[2]
        least, most = np.maximum(least, low[2]) - low[2], np.minimum(most, high[2]) - low[2]
        spans = []
        for _, _, _, codes in kinds:
            start = np.searchsorted(codes, np.where(there, column + least, 0))
            spans.append((start, np.where(there, np.searchsorted(codes, np.where(there, column + most, 0), "right") - start, 0)))
        number = n_a[begin : begin + slab]
        for i in np.flatnonzero(number * sum(n_b.sum(axis=1) for _, n_b in spans) >= MATRIX):
            enough[begin + i] = True
            for first in range(first_a[begin + i], first_a[begin + i] + number[i], 256):
                rows = slice(first, min(first + 256, first_a[begin + i] + number[i]))
                points, classes = place_a[:, by[rows]], class_a[rows]
                centre = (points.min(axis=1) + points.max(axis=1)) / 2
                away = points - centre[:, None]
                within = (far + np.sqrt((away * away).sum(axis=0).max())) ** 2
                cuts = [0, *(np.flatnonzero(np.diff(classes)) + 1), len(classes)]
                for (w, right, place, _), (start, n_b) in zip(kinds, spans, strict=True):
                    some = n_b[i] > 0
                    partners = runs(start[i][some], n_b[i][some])
                    partners = partners[_near(place, partners, centre, within)]
                    if len(partners):
                        total.exact(left[rows], right.take(partners, axis=0), [(slice(*c), float(w_a[classes[c[0]]]) * w) for c in itertools.pairwise(cuts)])
    done = np.zeros(len(by), bool)
    done[by] = np.repeat(enough, n_a)
    return done


def _near(place: np.ndarray, of: np.ndarray, centre: np.ndarray, within: float) -> np.ndarray:
    """Which points lie so near that the square of the distance to the centre is at most `within`."""
    total = None
    for axis in range(3):
        gap = place[axis].take(of)
        gap -= centre[axis]
        gap *= gap
        total = gap if total is None else np.add(total, gap, out=total)
    return np.flatnonzero(total <= within)


def matrices(a: dict[str, np.ndarray], b: dict[str, np.ndarray], tile: Tile, total: Matrix) -> np.ndarray:
    """Adds the pairs of all cells with partners enough, each with all the partners that it can reach, and returns which
    points of a have been dealt with. b is sorted by cells; no pair may depend on the order of ids."""
    if (done := exact_matrices(a, b, tile, total)) is not None:
        return done
    offsets = np.array(tile.offsets)
    low = b["cell"].min(axis=0)
    extent = b["cell"].max(axis=0) - low + 1
    code = lambda c: ((c[..., 0] - low[0]) * extent[1] + c[..., 1] - low[1]) * extent[2] + c[..., 2] - low[2]
    b_code = code(b["cell"].astype(np.int64))
    own, of = np.unique(a["cell"], axis=0, return_inverse=True)
    # where few products of weights occur, the rows of a matrix are in order of their weights
    (w_a, class_a), (w_b, class_b) = (np.unique(x["w"], return_inverse=True) if tile.weighted else (np.ones(1), None) for x in (a, b))
    total.grouped = tile.weighted and len(w_a) * len(w_b) <= PRODUCTS and bool(np.isfinite(w_a).all() and np.isfinite(w_b).all())
    by = np.lexsort((class_a, of.ravel())) if total.grouped else np.argsort(of.ravel(), kind="stable")
    n_a = np.bincount(of.ravel(), minlength=len(own))
    first_a = np.cumsum(n_a) - n_a
    done = np.zeros(len(of.ravel()), bool)
    sided = tile.sides is not None
    binning = tile.binning
    lifted = not sided and binning.scheme != "iso"
    places = [np.concatenate([p, [p[0] * p[0] + p[1] * p[1] + p[2] * p[2]]]) if lifted else p for p in (a["place"], b["place"])]
    far2 = binning.s.high**2 + (binning.pi.high**2 if binning.scheme == "spi" else 0.0)
    far2 = far2 * (1 + 1e-9) + (1e-12 * (places[0][3].max() + places[1][3].max()) if lifted else 0.0)
    # steps that stay inside the box lead to the nearest image, unless they are as long as half of it
    long = np.abs(offsets).max(axis=0)
    far = [sided and (long[i] + 1) * tile.size[i] > 0.499 * tile.sides[i] for i in range(3)]
    # whole numbers of which no sum of three products reaches 2 ** 53
    whole = not any(far) and all(float(x) == int(x) for x in tile.sides or ()) and all((p[:3] == np.floor(p[:3])).all() and np.abs(p[:3]).max() < 1 << 24 for p in places)
    slab = max(1, (1 << 20) // len(offsets))
    for begin in range(0, len(own), slab):
        here = own[begin : begin + slab].astype(np.int64)
        to = here[:, None, :] + offsets[None]
        if tile.cells:
            edge = (to < 0) | (to >= np.array(tile.cells))
            folds = edge.any(axis=1) | np.array(far)
            to %= np.array(tile.cells)
        there = ((to >= low) & (to < low + extent)).all(axis=2)
        wanted = code(np.where(there[:, :, None], to, low))
        start = np.searchsorted(b_code, wanted)
        n_b = np.where(there, np.searchsorted(b_code, wanted, "right") - start, 0)
        for i in np.flatnonzero(n_a[begin : begin + slab] * n_b.sum(axis=1) >= MATRIX):
            mine = by[first_a[begin + i] : first_a[begin + i] + n_a[begin + i]]
            done[mine] = True
            some = n_b[i] > 0
            all_ = runs(start[i][some], n_b[i][some])
            fold = tuple(folds[i].tolist()) if tile.cells else (False,) * 3
            for part in range(0, len(mine), 64):
                rows = mine[part : part + 64]
                p, gap2, moved = places[0][:, rows], 0.0, []
                for axis in range(3):
                    if fold[axis] and not whole:
                        continue
                    c = places[1][axis, all_]
                    if fold[axis]:  # to the image that is nearest to these points
                        side = tile.sides[axis]
                        c = c + side * ((c - p[axis, 0] < -0.5 * side).astype(float) - (c - p[axis, 0] > 0.5 * side))
                    if whole:
                        moved.append(c)
                    gap = np.maximum(np.maximum(p[axis].min() - c, c - p[axis].max()), 0.0)
                    gap2 = gap2 + gap * gap
                near = np.flatnonzero(gap2 <= far2) if whole or not all(fold) else np.arange(len(all_))
                others = all_[near]
                if not len(others):
                    continue
                spread = np.stack([c[near] for c in moved]) if whole else places[1][:, others]
                wa, wb = a["w"][rows], b["w"][others]
                sets = [(spread, wb, 1.0)]
                if total.grouped:
                    sets = [(spread, wb, w_b[0])] if len(w_b) == 1 else [(spread[:, of_w], wb[of_w], w) for k, w in enumerate(w_b) if (of_w := class_b[others] == k).any()]
                starts = np.flatnonzero(np.diff(wa)) + 1 if total.grouped else []
                cuts = [slice(*x) for x in itertools.pairwise([0, *starts, len(rows)])]
                for q, wq, w in sets:
                    groups = [(cut, float(wa[cut.start] * w) if total.grouped else 1.0) for cut in cuts]
                    if whole:
                        total.whole(p[:3], q, wa, wq, groups)
                    else:
                        total.add(p, q, wa, wq, fold, groups)
    return done


def separation(a: np.ndarray, b: np.ndarray, scheme: str, sides: tuple[float, float, float] | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Of points a and b (three rows of coordinates each): the square of s (spi: of its part across), and that of the
    part along the line of sight (spi in a box: that part itself); None for iso, where it plays no part."""
    if sides or scheme == "iso":
        d = [np.abs(x - y) for x, y in zip(a, b, strict=True)]
        if sides:
            d = [np.minimum(c, side - c) for c, side in zip(d, sides, strict=True)]  # of the nearest image
        if scheme == "spi":
            return d[0] * d[0] + d[1] * d[1], d[2]
        return d[0] * d[0] + d[1] * d[1] + d[2] * d[2], d[2] * d[2] if scheme == "smu" else None
    a2, b2 = (x[0] * x[0] + x[1] * x[1] + x[2] * x[2] for x in (a, b))
    total, twice = a2 + b2, 2.0 * (a[0] * b[0] + a[1] * b[1] + a[2] * b[2])
    s2, difference, sum2 = total - twice, a2 - b2, total + twice
    along2 = np.divide(difference * difference, sum2, out=np.zeros_like(sum2), where=sum2 > 0)
    return s2 - along2 if scheme == "spi" else s2, along2


def bins_of(s2: np.ndarray, along: np.ndarray | None, binning: Binning, periodic: bool) -> tuple[np.ndarray, np.ndarray]:
    """(pairs in range, their bin as s_idx * bins of the second kind + j_idx); a pair of mu = 1 is out of range unless mu_one."""
    if binning.scheme == "spi" and not periodic and binning.s.low == 0:
        s2 = np.maximum(s2, 0.0)  # the part across may come out a little below 0
    marks = np.array([e * e for e in binning.s.edges])
    inside = (s2 >= marks[0]) & (s2 < marks[-1])
    if binning.scheme == "spi":
        edges = np.array([e if periodic else e * e for e in binning.pi.edges])
        inside &= (along >= edges[0]) & (along < edges[-1])
    at = np.flatnonzero(inside)
    s = np.searchsorted(marks, s2[at], "right") - 1
    if binning.scheme == "iso":
        return at, s
    if binning.scheme == "spi":
        return at, s * binning.second + np.searchsorted(edges, along[at], "right") - 1
    n = binning.n_mu
    q = np.floor(along[at] * float(n * n) / np.where(s2[at] > 0, s2[at], 1.0))
    j = np.where(s2[at] <= 0, 0, np.where(q < n * n, np.floor(np.sqrt(q)), n - 1)).astype(np.int64)
    if not binning.mu_one:
        counted = (s2[at] <= 0) | (q < n * n)
        at, s, j = at[counted], s[counted], j[counted]
    return at, s * n + j


def sums(a: dict[str, np.ndarray], b: dict[str, np.ndarray], tile: Tile) -> tuple[np.ndarray, np.ndarray]:
    """Pairs, and sums of the products of their weights, by bin. a, b: id, place (three rows), w, cell (three columns)."""
    size = len(tile.binning.s) * tile.binning.second
    number, weight = np.zeros(size, np.int64), np.zeros(size)
    if not len(a["id"]) or not len(b["id"]):
        return number, weight
    by = np.lexsort(b["cell"].T[::-1])
    b = {"id": b["id"][by], "place": b["place"][:, by], "w": b["w"][by], "cell": b["cell"][by]}
    rest = [(a, tile)]
    if tile.order != "all":
        # pairs whose order counts, those of one cell, are compared one by one below, as are cells with few partners
        apart = tuple(o for o in tile.offsets if o != (0, 0, 0) or tile.order != "own")
        if apart:
            total = Matrix(tile)
            done = matrices(a, b, replace(tile, offsets=apart), total)
            number, weight = total.sums()
            few = {k: v[:, ~done] if k == "place" else v[~done] for k, v in a.items()}
            rest = [(few, replace(tile, offsets=apart))]
            if len(apart) < len(tile.offsets):
                rest.append((a, replace(tile, offsets=((0, 0, 0),))))
    for points, steps in rest:
        if not len(points["id"]):
            continue
        for i, j, same in candidates(points["cell"], b["cell"], steps):
            if tile.order == "all" or (tile.order == "own" and same):
                keep = points["id"][i] < b["id"][j]
                i, j = i[keep], j[keep]
            s2, along = separation(points["place"][:, i], b["place"][:, j], tile.binning.scheme, tile.sides)
            at, found = bins_of(s2, along, tile.binning, tile.sides is not None)
            if tile.counted:
                number = number + np.bincount(found, minlength=size)
            if tile.weighted:
                weight = weight + np.bincount(found, points["w"][i[at]] * b["w"][j[at]], size)
    return number, weight
