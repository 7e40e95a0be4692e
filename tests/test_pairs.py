import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import counts, estimators
from orrery.operators.bins import Binning, Edges
from orrery.operators.pairs import Box, catalog, pair_sums, pairs, wrapped
from orrery.streaming.counting import streamed_cross_counts

L = 100.0


def cloud(n, seed, low=0.0, high=L):
    r = np.random.default_rng(seed)
    return np.floor(r.uniform(low, high, (n, 3))), r.integers(1, 5, n).astype(float)


def frame(spark, points, weights):
    return spark.createDataFrame([(n, *map(float, p), float(w)) for n, (p, w) in enumerate(zip(points, weights))], "id long, x double, y double, z double, w double")


def brute(a, wa, b, wb, binning, box):
    """Counts and sums of weights by (bin, second bin), each unordered pair twice within one catalogue."""
    s, second = len(binning.s), binning.second
    cnt, total = np.zeros((second, s)), np.zeros((second, s))
    same = b is None
    b, wb = (a, wa) if same else (b, wb)
    for i in range(len(a)):
        for j in range(len(b)):
            if same and i == j:
                continue
            d = a[i] - b[j]
            if box:
                d = d - np.array(box.sides) * np.round(d / np.array(box.sides))
                s2, along = (d @ d, d[2] ** 2) if binning.scheme != "spi" else (d[0] ** 2 + d[1] ** 2, abs(d[2]))
            else:
                s2, m = d @ d, a[i] + b[j]
                along = ((a[i] @ a[i] - b[j] @ b[j]) ** 2) / (m @ m)
                if binning.scheme == "spi":
                    s2 = max(s2 - along, 0.0)
                    along = np.sqrt(along)
            if not binning.s.low**2 <= s2 < binning.s.high**2:
                continue
            p = np.searchsorted(np.square(binning.s.edges), s2, side="right") - 1
            q = 0
            if binning.scheme == "smu":
                q = int(np.floor(np.sqrt(np.floor(along * binning.n_mu**2 / s2)))) if s2 > 0 else 0
                if q >= binning.n_mu:
                    if not binning.mu_one:
                        continue
                    q = binning.n_mu - 1
            elif binning.scheme == "spi":
                if not binning.pi.low <= along < binning.pi.high:
                    continue
                q = np.searchsorted(binning.pi.edges, along, side="right") - 1
            cnt[q, p] += 1
            total[q, p] += wa[i] * wb[j]
    return cnt, total


BINNINGS = {
    "iso": Binning("iso", Edges.linear(0, 30, 5)),
    "iso_far": Binning("iso", Edges((7.0, 20.0, 49.0))),
    "smu": Binning("smu", Edges.linear(0, 30, 6), n_mu=8),
    "smu_one": Binning("smu", Edges.linear(0, 30, 6), n_mu=8, mu_one=True),
    "spi": Binning("spi", Edges.linear(0, 20, 5), pi=Edges.linear(0, 30, 4)),
    "spi_gap": Binning("spi", Edges.linear(4, 20, 4), pi=Edges.linear(5, 40, 7)),
}


@pytest.mark.parametrize("name", list(BINNINGS))
@pytest.mark.parametrize("boxed", [True, False])
def test_brute_force(spark, name, boxed):
    binning, box = BINNINGS[name], Box.of(L) if boxed else None
    shift = 0.0 if boxed else 300.0
    (a, wa), (b, wb) = cloud(90, 1, shift, shift + L), cloud(70, 2, shift, shift + L)
    da, db = frame(spark, a, wa), frame(spark, b, wb)
    for auto, weighted in ((True, False), (False, True)):
        cnt, total = brute(a, wa, None if auto else b, wb, binning, box)
        got = counts.pair_counts(da, None if auto else db, binning, box, weighted=weighted).collect()
        assert len(got) == cnt.size
        for r in got:
            assert r.cnt == (total if weighted else cnt)[r.j_idx, r.s_idx]
    if name == "iso":
        assert pairs(da, db, binning, box).count() == pairs(da, db, binning, box, refine=2).count() == pairs(da, db, binning, box, salt=3).count()
        assert pairs(da, None, binning, box).count() == pairs(da, None, binning, box, refine=2, salt=2).count()


@pytest.mark.parametrize(("name", "boxed"), [("iso", True), ("smu_one", False), ("spi", True), ("spi_gap", False)])
def test_tiles(spark, monkeypatch, name, boxed):
    """Clustered points in small blocks, crowded tiles and fine cells, against the join that makes pairs."""
    monkeypatch.setattr("orrery.operators.pairs.BLOCK_POINTS", 60)
    monkeypatch.setattr("orrery.operators.pairs.TILE_POINTS", 45)
    monkeypatch.setattr("orrery.operators.pairs.CELL_POINTS", 6.0)
    monkeypatch.setattr("orrery.operators.kernel.CHUNK", 500)
    binning, box, r = BINNINGS[name], Box.of(L) if boxed else None, np.random.default_rng(8)
    spots = [np.floor(r.normal(c, 6, (60, 3))) for c in (5, 98)] + [np.floor(r.uniform(0, L, (40, 3)))]
    a = np.concatenate(spots) + (0.0 if boxed else 300.0)
    da, db = (frame(spark, p, 1.0 + np.arange(len(p)) % 3) for p in (a, a[::2] + 1.0))
    inside = lambda df: wrapped(df, box) if boxed else df
    for left, right in ((da, None), (da, db)):
        want = pairs(inside(left), None if right is None else inside(right), binning, box).where("j_idx >= 0").groupBy("s_idx", "j_idx").agg(F.count("*"), F.sum("w")).collect()
        assert {tuple(x) for x in pair_sums(left, right, binning, box).collect()} == {tuple(x) for x in want}


def test_outside_the_box(spark):
    iso = Binning("iso", Edges.linear(0, 20, 5))
    df = frame(spark, np.array([(99.0, 0, 0), (-99.0, 0, 0), (201.5, 100.0, -100.0), (float("inf"), 0, 0), (1.0, float("nan"), 0)]), [1.0] * 5)
    got = {r.s_idx: r.cnt for r in counts.pair_counts(df, None, iso, Box.of(L)).where("cnt > 0").collect()}
    assert got == {0: 6}
    none = df.where("id < 0")
    assert pair_sums(none, None, iso).count() == 0 and pair_sums(none, df, iso, Box.of(L)).count() == 0


def test_small_cases(spark):
    def run(points, binning, box=None, **more):
        df = frame(spark, np.array(points, float), [1.0] * len(points))
        return {(r.s_idx, r.j_idx): r.cnt for r in counts.pair_counts(df, None, binning, box, **more).where("cnt > 0").collect()}

    iso = Binning("iso", Edges.linear(0, 20, 5))
    assert run([(10, 0, 0), (15, 0, 0)], iso) == {(1, 0): 2}  # on an edge
    assert run([(1, 5, 5), (99, 5, 5)], iso, Box.of(L)) == {(0, 0): 2}  # nearest image
    assert run([(5, 5, 5), (5, 5, 5)], BINNINGS["smu"], Box.of(L)) == {(0, 0): 2}
    assert run([(5, 5, 5), (5, 5, 9)], BINNINGS["smu"], Box.of(L)) == {}  # mu = 1
    assert run([(5, 5, 5), (5, 5, 9)], BINNINGS["smu_one"], Box.of(L)) == {(0, 7): 2}
    assert run([(float("nan"), 5, 5), (5, 5, 9)], iso) == {}
    one = counts.pair_counts(frame(spark, np.array([(1.0, 1, 1)]), [1.0]), None, iso, Box.of(L)).first()
    assert one.norm == 0 and np.isnan(one.ncnt)
    with pytest.raises(ValueError):
        run([(1, 1, 1)], Binning("iso", Edges.linear(0, 50, 5)), Box.of(L))
    with pytest.raises(ValueError):
        Box.of([1.0, 2.0])
    assert [r.x for r in wrapped(frame(spark, np.array([(-1.0, 0, 0), (100.0, 0, 0)]), [1, 1]), Box.of(L)).orderBy("id").collect()] == [99.0, 0.0]


def test_oblong_box(spark):
    box = Box(60.0, 100.0, 140.0)
    r = np.random.default_rng(5)
    a, w = r.uniform(0, 1, (80, 3)) * np.array(box.sides), np.ones(80)
    for binning in (Binning("iso", Edges.linear(0, 28, 7)), Binning("spi", Edges.linear(0, 25, 5), pi=Edges.linear(0, 60, 10))):
        cnt, _ = brute(a, w, None, w, binning, box)
        for row in counts.pair_counts(frame(spark, a, w), None, binning, box).collect():
            assert row.cnt == cnt[row.j_idx, row.s_idx]


def test_uniform_box(spark):
    r = np.random.default_rng(3)
    df = frame(spark, r.uniform(0, L, (3000, 3)), np.ones(3000))
    binning = Binning("iso", Edges((20.0, 30.0)))
    tables = {"DD": counts.pair_counts(df, None, binning, Box.of(L)), "@@": counts.analytic_counts(binning, Box.of(L), spark)}
    assert abs(estimators.estimate(tables, "DD/@@-1").first().xi) < 0.02


def test_products(spark):
    df = frame(spark, *cloud(200, 7))
    smu, spi = BINNINGS["smu"], BINNINGS["spi"]
    xi = estimators.estimate({"DD": counts.pair_counts(df, None, smu, Box.of(L)), "@@": counts.analytic_counts(smu, Box.of(L), spark)}, "DD / @@ - 1")
    rows = xi.collect()
    mono = {r.s_idx: r.xi_0 for r in estimators.multipoles(xi, [2, 0, 2], 8).collect()}
    for s in range(len(smu.s)):
        assert mono[s] == pytest.approx(np.mean([r.xi for r in rows if r.s_idx == s]))
    xi = estimators.estimate({"DD": counts.pair_counts(df, None, spi, Box.of(L)), "@@": counts.analytic_counts(spi, Box.of(L), spark)}, "DD / @@ - 1")
    wp = {r.s_idx: r.wp for r in estimators.projected(xi).collect()}
    assert wp[0] == pytest.approx(sum(2 * r.xi * (r.j_max - r.j_min) for r in xi.collect() if r.s_idx == 0))
    for bad in ("DD / RR", "1 + 2", "DD / ("):
        with pytest.raises(ValueError):
            estimators.estimate({"DD": xi.withColumn("ncnt", xi.xi)}, bad)


def test_catalog_and_stream(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, None)], "a double, b double, c double, v double")
    assert catalog(df, x="a", y="b", z="c", w="v").first().w == 1.0
    (a, wa), (b, wb) = cloud(40, 1), cloud(30, 2)
    frame(spark, a, wa).write.parquet(f"{tmp_path}/in")
    arriving = spark.readStream.schema("id long, x double, y double, z double, w double").parquet(f"{tmp_path}/in")
    query = streamed_cross_counts(arriving, frame(spark, b, wb), BINNINGS["iso"], Box.of(L)).writeStream.format("memory").queryName("streamed").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    cnt, _ = brute(a, wa, b, wb, BINNINGS["iso"], Box.of(L))
    assert {r.s_idx: r.cnt for r in spark.sql("select * from streamed").collect()} == {n: c for n, c in enumerate(cnt[0]) if c}
