"""Dense tiles: the matrices against the comparison pair by pair, which they have to replace."""

import numpy as np
import pytest

from orrery.operators import kernel
from orrery.operators.bins import Binning, Edges
from orrery.operators.pairs import Box, Grid, reach

BINNINGS = {
    "iso": Binning("iso", Edges.linear(0, 30, 5)),
    "iso_uneven": Binning("iso", Edges((1.1, 7.3, 29.9))),
    "smu": Binning("smu", Edges.linear(0, 30, 6), n_mu=8),
    "smu_one": Binning("smu", Edges.linear(6, 30, 6), n_mu=8, mu_one=True),
    "spi": Binning("spi", Edges.linear(4, 20, 4), pi=Edges.linear(0, 30, 4)),
}


@pytest.mark.parametrize("name", list(BINNINGS))
@pytest.mark.parametrize("boxed", [True, False])
@pytest.mark.parametrize("whole", [True, False])
def test_matrices(monkeypatch, name, boxed, whole):
    binning, box, r = BINNINGS[name], Box.of(100.0) if boxed else None, np.random.default_rng(3)
    grid = Grid.of(reach(binning, box), box, 3)
    offsets = grid.offsets(None if box and binning.scheme == "spi" else reach(binning, box)[0] ** 2)

    def points(n):
        place = r.uniform(0, 40, (3, n)) + (85.0 if boxed else 300.0)
        place = np.floor(place) if whole else place
        place = place % 100.0 if boxed else place
        cell = np.floor(place / np.array(grid.size)[:, None]).astype(np.int64).T
        return {"id": np.arange(n), "place": place, "w": 1.0 + np.arange(n) % 3, "cell": np.minimum(cell, np.array(grid.cells) - 1) if boxed else cell}

    a, b = points(1500), points(1500)
    compared = []
    one_by_one = kernel.separation
    monkeypatch.setattr(kernel, "separation", lambda x, y, *more: (compared.append(x.shape[1]), one_by_one(x, y, *more))[1])
    half = grid.halved(offsets)
    for left, order in ((a, "none"), (b, "own")):
        steps = tuple(o for o in offsets if order == "none" or o >= (0, 0, 0)) if half else tuple(offsets)
        tile = kernel.Tile(binning, box and box.sides, grid.cells, steps, order if half or order == "none" else "all", grid.size)
        compared.clear()
        number, weight = kernel.sums(left, b, tile)
        few = sum(compared)
        monkeypatch.setattr(kernel, "MATRIX", 1 << 60)
        compared.clear()
        want, want_weight = kernel.sums(left, b, tile)
        monkeypatch.undo()
        monkeypatch.setattr(kernel, "separation", lambda x, y, *more: (compared.append(x.shape[1]), one_by_one(x, y, *more))[1])
        assert want.sum() > 10_000 and (number == want).all() and np.allclose(weight, want_weight, rtol=1e-12)
        assert tile.order == "all" or few < sum(compared) / 4
        if order == "none":
            only = kernel.sums(left, b, kernel.replace(tile, counted=False))
            assert not only[0].any() and np.allclose(only[1], weight, rtol=1e-12)
