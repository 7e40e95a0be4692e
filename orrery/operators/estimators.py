"""Correlation functions: estimator expressions over aligned pair counts, multipoles, projection."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions import expr
from orrery.functions.legendre import polynomial_of
from orrery.operators.bins import Binning

ANALYTIC = "@@"
_LABEL = re.compile(r"@@|(?<![A-Za-z0-9_$])[A-Z]{2}(?![A-Za-z0-9_(])")
KEYS = ["s_idx", "j_idx"]


def labels(expression: str) -> list[str]:
    """The pair labels in an estimator, in order of first use."""
    return list(dict.fromkeys(_LABEL.findall(expression)))


def parse(expression: str) -> expr.Node:
    return expr.parse(_LABEL.sub(lambda m: "${" + m[0] + "}", expression))


def estimate(tables: dict[str, DataFrame], expression: str, name: str = "xi") -> DataFrame:
    """The expression in every bin, over the tables' normalised counts (ncnt): the bins' columns and `name`."""
    tree, used = parse(expression), labels(expression)
    missing = [u for u in used if u not in tables]
    if missing:
        raise expr.ExpressionError(f"no pair counts for {', '.join(missing)}")
    if not used:
        raise expr.ExpressionError("an estimator needs pair counts")
    edges = ["s_min", "s_max", "s_cen", "j_min", "j_max"]
    out = tables[used[0]].select(*KEYS, *edges, F.col("ncnt").alias(f"n_{used[0]}"))
    for u in used[1:]:
        out = out.join(tables[u].select(*KEYS, F.col("ncnt").alias(f"n_{u}")), KEYS)
    return out.select(*KEYS, *edges, expr.as_double(tree, lambda v: F.col(f"`n_{v}`")).alias(name))


def multipoles(xi: DataFrame, orders: list[int], n_mu: int, name: str = "xi") -> DataFrame:
    """xi_l(s) for each order, ascending: the sum over mu bins of xi (2 l + 1) / n_mu P_l at the bin's middle."""
    mu = (F.col("j_idx") + 0.5) / F.lit(float(n_mu))
    sums = [F.sum(F.col(name) * F.lit((2 * l + 1) / n_mu) * polynomial_of(l, mu)).alias(f"xi_{l}") for l in sorted(set(orders))]
    return xi.groupBy("s_idx", "s_cen", "s_min", "s_max").agg(*sums)


def projected(xi: DataFrame, name: str = "xi") -> DataFrame:
    """wp: twice the sum of xi times the width of the pi bins."""
    width = F.col("j_max") - F.col("j_min")
    return xi.groupBy("s_idx", "s_cen", "s_min", "s_max").agg(F.sum(F.lit(2.0) * F.col(name) * width).alias("wp"))


def check_products(binning: Binning, orders: list[int], want_projected: bool) -> None:
    if orders and binning.scheme != "smu":
        raise ValueError("multipoles need the smu scheme")
    if any(not 0 <= l <= 6 for l in orders):
        raise ValueError("multipoles go from 0 to 6")
    if want_projected and binning.scheme != "spi":
        raise ValueError("a projected correlation function needs the spi scheme")
