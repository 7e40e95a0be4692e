"""Whole coordinates: products of matrices against the comparison pair by pair, and sums that are wanted alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import kernel, pairs
from orrery.operators.bins import Binning, Edges
from orrery.operators.pairs import Box, Grid, reach

BINNINGS = {
    "iso": Binning("iso", Edges.linear(0, 30, 5)),
    "iso_uneven": Binning("iso", Edges((2.5, 7.0, 29.5))),
    "smu": Binning("smu", Edges.linear(0, 30, 6), n_mu=10),
    "smu_one": Binning("smu", Edges.linear(6, 30, 6), n_mu=4, mu_one=True),
}


@pytest.mark.parametrize("name", list(BINNINGS))
@pytest.mark.parametrize("boxed", [True, False])
@pytest.mark.parametrize("classes", [1, 3, 1000])
def test_exact_matrices(monkeypatch, name, boxed, classes):
    binning, box, r = BINNINGS[name], Box.of(300.0) if boxed else None, np.random.default_rng(5)
    if not boxed and binning.scheme != "iso":
        pytest.skip("goes by the line of sight")
    grid = Grid.of(reach(binning, box), box, 2)
    offsets = grid.offsets(reach(binning, box)[0] ** 2)

    def points(n, low, high):
        place = np.floor(r.uniform(low, high, (3, n)))
        place = place % 300.0 if boxed else place
        cell = np.floor(place / np.array(grid.size)[:, None]).astype(np.int64).T
        return {"id": r.permutation(n), "place": place, "w": 1.0 + np.arange(n) % classes, "cell": cell}

    a, b = points(1200, 0, 40), points(4000, -35, 75)  # partners across the sides of the box
    a |= {"w": 1.0 + np.arange(1200) % 3}
    used, make = [], kernel.exact_matrices
    monkeypatch.setattr(kernel, "exact_matrices", lambda *x: (used.append(make(*x)), used[-1])[1])
    for order, steps in (("none", offsets), ("own", [o for o in offsets if o >= (0, 0, 0)])):
        tile = kernel.Tile(binning, box and box.sides, grid.cells, tuple(steps), order, grid.size)
        number, weight = kernel.sums(a, b, tile)
        assert (used[-1] is not None and used[-1].any()) == (classes < 1000)
        with monkeypatch.context() as m:
            m.setattr(kernel, "MATRIX", 1 << 60)
            want, want_weight = kernel.sums(a, b, tile)
        assert want.sum() > 10_000 and (number == want).all() and np.allclose(weight, want_weight, rtol=1e-12)


def test_sums_that_are_not_wanted(spark):
    """Pairs were counted for weighted sums as well."""
    df = pairs.catalog(spark.range(400).select("id", *[F.floor(F.rand(i) * 60).cast("double").alias(a) for i, a in enumerate("xyz")]), id="id")
    for counted, weighted in ((True, False), (False, True)):
        found = pairs.pair_sums(df, df, BINNINGS["iso"], Box.of(100.0), counted, weighted).agg(F.sum("n"), F.sum("w")).first()
        assert (found[0] > 0, found[1] > 0) == (counted, weighted)
