import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import cosmology, expr, legendre
from orrery.operators.bins import Binning, Edges


@pytest.mark.parametrize(
    ("text", "value"),
    [("2**3**2", 64), ("-2**2", 4), ("7/2", 3), ("7/2.0", 3.5), ("-7 % 2", -1), ("log(100)", 2), ("ln(0)", -math.inf), ("1 + 2 * 3 - 4 / 2", 5), ("0x10 + 1e1", 26), ("abs(3 - 5) ** 2", 4), (".5 * 4.", 2), ("sqrt(-1)", math.nan), ("0.0/0", math.nan), ("(1 | 6) & 3 ^ 1 << 2", 7)],
)
def test_values(spark, text, value):
    tree = expr.parse(text)
    got = expr.evaluate(tree, {})
    assert got == value or math.isnan(got) and math.isnan(value)
    if "|" not in text and "/2" not in text:
        got = spark.range(1).select(expr.as_double(tree, F.col).alias("v")).first().v
        assert got == value or math.isnan(got) and math.isnan(value)


@pytest.mark.parametrize("text", ["", "1 +", "+1", "(1", "1)", "foo(1)", "$0", "log (1)", "1 2", "'a", "abs 1"])
def test_errors(text):
    with pytest.raises(expr.ExpressionError):
        expr.parse(text)


def test_types(spark):
    df = spark.createDataFrame([(5, 2.0, "YES"), (6, float("nan"), "NO"), (7, float("inf"), "YES ")], "a long, b double, c string")
    kinds = {"a": "long", "b": "double", "c": "string"}

    def rows(text):
        return [r.a for r in df.where(expr.as_bool(expr.parse(text), F.col, kinds.__getitem__)).orderBy("a").collect()]

    assert rows("isfinite(${b}) && ${c} == 'YES'") == [5]
    assert rows("(${a} & 1) != 0") == [5, 7]
    assert rows("${b} != ${b}") == [6]
    assert rows("${b} > 0") == [5, 7]
    assert rows("!(${a} % 5) || ${a} / 2 == 3 && ~${a} < -7") == [5, 7]
    assert rows("1 == 1") == [5, 6, 7]
    for bad in ("${a}", "${a} + ${c} == 1", "${b} & 1 == 1", "'a' < 'b'"):
        with pytest.raises(expr.ExpressionError):
            rows(bad)
    with pytest.raises(expr.ExpressionError):
        expr.as_double(expr.parse("${a} < 2"), F.col)


def test_legendre(spark):
    x = np.linspace(-1, 1, 9)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    for order in range(7):
        got = [r[0] for r in df.select(legendre.polynomial_of(order, F.col("x")), "x").orderBy("x").collect()]
        assert np.allclose(got, np.polynomial.legendre.Legendre.basis(order)(x), atol=1e-12)
    with pytest.raises(ValueError):
        legendre.polynomial_of(7, F.col("x"))


def test_distances(spark):
    flat = cosmology.Cosmology(1.0)
    order = flat.order_for(0.0, 2.0)
    z = np.array([0.0, 0.3, 1.0, 2.0])
    exact = 2 * cosmology.HUBBLE_DISTANCE * (1 - 1 / np.sqrt(1 + z))
    assert np.allclose(flat.distance(z, order), exact, rtol=1e-7)
    df = spark.createDataFrame([(float(v),) for v in z], "red double")
    got = [r[0] for r in df.select(flat.distance_column(F.col("red"), order), "red").orderBy("red").collect()]
    assert np.allclose(got, exact, rtol=1e-7)
    for bad in ({"omega_m": 0.0}, {"omega_m": 0.3, "omega_l": -0.1}, {"omega_m": 0.3, "w": 0.0}):
        with pytest.raises(ValueError):
            cosmology.Cosmology(**bad)
    with pytest.raises(ValueError):
        flat.order_for(-0.1, 1.0)


def test_spline(spark):
    z = [0.4, 0.0, 0.1, 0.9, 0.6]
    s = cosmology.Spline(z, [3000 * v - 500 * v * v for v in z])
    df = spark.createDataFrame([(float(v),) for v in (-0.1, 0.0, 0.05, 0.1, 0.5, 0.899, 0.9)], "red double")
    got = [r[0] for r in df.select(s.distance_column(F.col("red")), "red").orderBy("red").collect()]
    assert got[0] == got[-1] == math.inf
    assert got[1] == 0 and got[3] == pytest.approx(295)
    assert got[4] == pytest.approx(1375, rel=5e-3)


def test_edges(spark):
    assert len(Edges.linear(10, 145, 7)) == 20 and Edges.linear(10, 145, 7).high == 150
    assert Edges.linear(10, 150, 7).edges == Edges.linear(10, 145, 7).edges
    assert len(Edges.linear(0, 200, 5)) == 40
    for bad in (lambda: Edges.pairs([(0, 1), (1.1, 2)]), lambda: Edges((1.0, 1.0)), lambda: Edges.linear(0, 1, 0), lambda: Edges.linear(0, 1e6, 1), lambda: Binning("smu", Edges((0.0, 1.0)), n_mu=256), lambda: Binning("spi", Edges((0.0, 1.0)))):
        with pytest.raises(ValueError):
            bad()
    rng = np.random.default_rng(1)
    for edges in (Edges.linear(0, 20, 5), Edges.logarithmic(1, 100, 8), Edges.linear(0, 300, 1), Edges(tuple(np.cumsum(rng.uniform(0.1, 1, 301)).tolist()))):
        inside = rng.uniform(edges.low, edges.high, 200)
        values = np.concatenate([np.square(inside), np.array([e * e for e in edges.edges[:-1]])])
        df = spark.createDataFrame([(n, float(v)) for n, v in enumerate(values)], "n long, v double")
        got = [r[0] for r in df.select(edges.index(F.col("v"), True), "n").orderBy("n").collect()]
        want = np.searchsorted(np.array([e * e for e in edges.edges]), values, side="right") - 1
        assert got == want.tolist()
