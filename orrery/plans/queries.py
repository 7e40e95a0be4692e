"""The queries over the provided tables, with brute-force SQL to check each against.

Points come from dense keys by fixed primes: x = (key * 7919) mod 1009, y = (key * 104729) mod 1013 and z = (key *
1299709) mod 1019, in a box of side 1024. All coordinates are whole, so squared distances are exact in both engines.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import cosmology, expr
from orrery.operators import counts, estimators
from orrery.operators.bins import Binning, Edges
from orrery.operators.pairs import Box

BOX = Box.of(1024.0)
DATA, RANDOM = (7919, 104729, 1299709), (15485863, 32452843, 49979687)
_MODULI = (1009, 1013, 1019)
ISO = Binning("iso", Edges.linear(0, 50, 5))
SMU = Binning("smu", Edges.linear(0, 60, 6), n_mu=10)
SPI = Binning("spi", Edges.linear(0, 40, 5), pi=Edges.linear(0, 40, 4))
WIDE = Binning("iso", Edges.linear(10, 60, 10))
WIDE_SMU = Binning("smu", Edges.linear(10, 60, 10), n_mu=5)
WIDE_SPI = Binning("spi", Edges.linear(10, 60, 10), pi=Edges.linear(0, 60, 12))
MU_ONE = Binning("smu", Edges.linear(0, 60, 6), n_mu=4, mu_one=True)
CUSTOM = Binning("iso", Edges.pairs([(1.0, 2.5), (2.5, 7.0), (7.0, 19.0), (19.0, 23.0), (23.0, 55.0)]))
LOG = Binning("iso", Edges.logarithmic(1.0, 64.0, 6))
KNOTS = ([0.96, 0.0, 0.2, 0.4, 0.05, 0.7], [2327.0, 0.0, 571.0, 1077.0, 148.0, 1759.0])
COSMOLOGY, GL_ORDER, CHOSEN_ERROR = cosmology.Cosmology(0.31), 12, 1e-5


# --- catalogues ----------------------------------------------------------------------------------------------------


def points(spark: SparkSession, sf_dir: str, *, primes: tuple = DATA, shift: float = 0.0) -> DataFrame:
    """orders as a catalogue; the weight comes from the customer."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey").cast("long")
    place = [((k * F.lit(p)) % F.lit(m)).cast("double") + F.lit(shift) for p, m in zip(primes, _MODULI, strict=True)]
    return orders.select(k.alias("id"), *[c.alias(n) for c, n in zip(place, "xyz", strict=True)], (1 + F.col("o_custkey") % 3).cast("double").alias("w"))


def _points_sql(name: str, primes: tuple = DATA, shift: float = 0.0) -> str:
    place = ", ".join(f"((o_orderkey::BIGINT * {p}) % {m})::DOUBLE + {float(shift)} AS {n}" for p, m, n in zip(primes, _MODULI, "xyz", strict=True))
    return f"{name} AS (SELECT o_orderkey::BIGINT AS id, {place}, (1 + o_custkey % 3)::DOUBLE AS w FROM orders)"


def _edges_sql(edges: Edges, name: str, index: str) -> str:
    rows = ", ".join(f"({i}, {a!r}::DOUBLE, {b!r}::DOUBLE)" for i, (a, b) in enumerate(zip(edges.edges, edges.edges[1:])))
    return f"{name}({index}, {index[0]}_min, {index[0]}_max) AS (VALUES {rows})"


def _bins_sql(b: Binning) -> list[str]:
    out = [_edges_sql(b.s, "s_edges", "s_idx")]
    if b.scheme == "spi":
        out.append(_edges_sql(b.pi, "j_edges", "j_idx"))
    elif b.scheme == "smu":
        out.append(f"j_edges AS (SELECT range::INT AS j_idx, range / {float(b.n_mu)} AS j_min, (range + 1) / {float(b.n_mu)} AS j_max FROM range({b.n_mu}))")
    else:
        out.append("j_edges AS (SELECT 0 AS j_idx, NULL::DOUBLE AS j_min, NULL::DOUBLE AS j_max)")
    return out


def _count_sql(name: str, left: str, right: str, b: Binning, box: bool, weighted: bool = False) -> str:
    """A dense table `name` of (s_idx, j_idx, s_min, s_max, j_min, j_max, cnt, norm, ncnt), by testing every pair."""
    auto = left == right
    if box:
        d = {a: f"(CASE WHEN a.{a} - b.{a} > 512 THEN a.{a} - b.{a} - 1024 WHEN a.{a} - b.{a} < -512 THEN a.{a} - b.{a} + 1024 ELSE a.{a} - b.{a} END)" for a in "xyz"}
        xy, z2 = f"{d['x']} * {d['x']} + {d['y']} * {d['y']}", f"{d['z']} * {d['z']}"
        measure = (xy, f"abs({d['z']})") if b.scheme == "spi" else (f"{xy} + {z2}", z2)
    elif b.scheme == "iso":
        measure = " + ".join(f"(a.{a} - b.{a}) * (a.{a} - b.{a})" for a in "xyz"), "0.0"
    else:
        r = {t: f"({t}.x * {t}.x + {t}.y * {t}.y + {t}.z * {t}.z)" for t in "ab"}
        twice = "2.0 * (a.x * b.x + a.y * b.y + a.z * b.z)"
        total = f"({r['a']} + {r['b']})"
        along = f"(({r['a']} - {r['b']}) * ({r['a']} - {r['b']}) / ({total} + {twice}))"
        s2 = f"({total} - {twice})"
        measure = (f"greatest({s2} - {along}, 0.0)" if b.s.low == 0 else f"{s2} - {along}", along) if b.scheme == "spi" else (s2, along)
    join = f"{left} a JOIN {right} b ON a.id < b.id" if auto else f"{left} a CROSS JOIN {right} b"
    keep = f"s2 >= {b.s.low**2!r} AND s2 < {b.s.high**2!r}"
    j = "0"
    if b.scheme == "smu":
        j = f"CASE WHEN s2 <= 0 THEN 0 WHEN floor(along * {float(b.n_mu**2)} / s2) < {b.n_mu**2} THEN floor(sqrt(floor(along * {float(b.n_mu**2)} / s2)))::INT{f' ELSE {b.n_mu - 1}' if b.mu_one else ''} END"
    elif b.scheme == "spi":
        j = "j_edges.j_idx"
    p = (lambda e: e) if box else (lambda e: f"{e} * {e}")
    more = f" JOIN j_edges ON along >= {p('j_edges.j_min')} AND along < {p('j_edges.j_max')}" if b.scheme == "spi" else ""
    value = "sum(w)" if weighted else "count(*)"
    zero = "0.0" if weighted else "0"
    size = lambda t: f"(SELECT {'sum(w)' if weighted else 'count(*)'} FROM {t})"
    norm = f"({size(left)} * ({size(left)} - 1))::DOUBLE" if auto else f"({size(left)} * {size(right)})::DOUBLE"
    return f"""{name}_pairs AS (SELECT {measure[0]} AS s2, {measure[1]} AS along, a.w * b.w AS w FROM {join}),
{name}_sums AS (SELECT s_edges.s_idx, {j} AS j_idx, {value} AS found FROM (SELECT * FROM {name}_pairs WHERE {keep}) p JOIN s_edges ON s2 >= s_min * s_min AND s2 < s_max * s_max{more} GROUP BY 1, 2),
{name} AS (SELECT s.s_idx::INT AS s_idx, j.j_idx::INT AS j_idx, s.s_min, s.s_max, j.j_min, j.j_max, coalesce(found, {zero}) * {2 if auto else 1} AS cnt, {norm} AS norm, coalesce(found, {zero}) * {2 if auto else 1} / {norm} AS ncnt FROM s_edges s CROSS JOIN j_edges j LEFT JOIN {name}_sums f ON f.s_idx = s.s_idx AND f.j_idx = j.j_idx)"""


def _counts(df: DataFrame, weighted: bool = False) -> DataFrame:
    return df.select("s_idx", "j_idx", "s_min", "s_max", "j_min", "j_max", F.col("cnt").cast("double" if weighted else "long").alias("cnt"), "norm", F.round("ncnt", 15).alias("ncnt"))


def _counts_sql(b: Binning, box: bool, left: tuple = ("d", DATA), right: tuple | None = None, weighted: bool = False) -> str:
    shift = 0.0 if box else 2000.0
    parts = [_points_sql(*left, shift), *([_points_sql(*right, shift)] if right else []), *_bins_sql(b), _count_sql("c", left[0], right[0] if right else left[0], b, box, weighted)]
    kind = "DOUBLE" if weighted else "BIGINT"
    return f"WITH {', '.join(parts)} SELECT s_idx, j_idx, s_min, s_max, j_min, j_max, cnt::{kind} AS cnt, norm, round(ncnt, 15) AS ncnt FROM c"


def _counted(b: Binning, box: Box | None, cross: bool = False, weighted: bool = False, one_sided: bool = False):
    """one_sided: only the left catalogue has weights, and the pairs are weighted all the same."""
    shift = 0.0 if box else 2000.0

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        right = points(spark, sf_dir, primes=RANDOM, shift=shift) if cross else None
        right = right.withColumn("w", F.lit(1.0)) if one_sided else right
        return _counts(counts.pair_counts(points(spark, sf_dir, shift=shift), right, b, box, weighted=weighted), weighted)

    sql = _counts_sql(b, box is not None, right=("r", RANDOM) if cross else None, weighted=weighted)
    if one_sided:
        head, mark, rest = sql.partition("r AS (")
        sql = head + mark + rest.replace("(1 + o_custkey % 3)::DOUBLE AS w", "1.0::DOUBLE AS w", 1)
    return run, sql


# --- estimators ----------------------------------------------------------------------------------------------------


def _natural(b: Binning, product: str | None = None, orders: tuple[int, ...] = (0, 2, 4)):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        dd = counts.pair_counts(points(spark, sf_dir), None, b, BOX)
        xi = estimators.estimate({"DD": dd, "@@": counts.analytic_counts(b, BOX, spark)}, "DD / @@ - 1")
        if product == "multipoles":
            out = estimators.multipoles(xi, orders, b.n_mu)
            return out.select("s_idx", "s_cen", "s_min", "s_max", *[F.round(f"xi_{l}", 8).alias(f"xi_{l}") for l in orders])
        if product == "wp":
            return estimators.projected(xi).select("s_idx", "s_cen", "s_min", "s_max", F.round("wp", 8).alias("wp"))
        return xi.select("s_idx", "j_idx", "s_min", "s_max", F.round("xi", 8).alias("xi"))

    volume = "1073741824.0"
    if b.scheme == "spi":
        rr = f"(2 * pi() * (j_max - j_min) * (s_max * s_max - s_min * s_min) / {volume})"
    else:
        rr = f"(4 * pi() * (s_max * s_max * s_max - s_min * s_min * s_min) / ({3.0 * b.second} * {volume}))"
    head = f"WITH {_points_sql('d')}, {', '.join(_bins_sql(b))}, {_count_sql('c', 'd', 'd', b, True)}, xi AS (SELECT *, ncnt / {rr} - 1 AS xi FROM c)"
    if product == "multipoles":
        mu = f"((j_idx + 0.5) / {float(b.n_mu)})"
        power = lambda n: " * ".join(["1.0::DOUBLE", *[mu] * n])
        terms = {l: " + ".join(f"({c!r}::DOUBLE * {power(n)})" for n, c in enumerate(np.polynomial.legendre.leg2poly([0.0] * l + [1.0]).tolist())) for l in orders}
        sums = ", ".join(f"round(sum(xi * {(2 * l + 1) / b.n_mu!r} * ({p})), 8) AS xi_{l}" for l, p in terms.items())
        return run, f"{head} SELECT s_idx, (s_min + s_max) / 2 AS s_cen, s_min, s_max, {sums} FROM xi GROUP BY ALL"
    if product == "wp":
        return run, f"{head} SELECT s_idx, (s_min + s_max) / 2 AS s_cen, s_min, s_max, round(sum(2 * xi * (j_max - j_min)), 8) AS wp FROM xi GROUP BY ALL"
    return run, f"{head} SELECT s_idx, j_idx, s_min, s_max, round(xi, 8) AS xi FROM xi"


def _landy_szalay(b: Binning, weighted: bool = False):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d, r = points(spark, sf_dir, shift=2000.0).persist(), points(spark, sf_dir, primes=RANDOM, shift=2000.0).persist()
        both = counts.totals(d), counts.totals(r)
        tables = {
            "DD": counts.pair_counts(d, None, b, weighted=weighted, sizes=(both[0], None)),
            "DR": counts.pair_counts(d, r, b, weighted=weighted, sizes=both),
            "RR": counts.pair_counts(r, None, b, weighted=weighted, sizes=(both[1], None)),
        }
        return estimators.estimate(tables, "(DD - 2 * DR + RR) / RR").select("s_idx", "j_idx", "s_min", "s_max", F.round("xi", 8).alias("xi"))

    parts = [_points_sql("d", DATA, 2000.0), _points_sql("r", RANDOM, 2000.0), *_bins_sql(b), *(_count_sql(n, x, y, b, False, weighted) for n, x, y in (("dd", "d", "d"), ("dr", "d", "r"), ("rr", "r", "r")))]
    return run, f"WITH {', '.join(parts)} SELECT dd.s_idx, dd.j_idx, dd.s_min, dd.s_max, round((dd.ncnt - 2 * dr.ncnt + rr.ncnt) / rr.ncnt, 8) AS xi FROM dd JOIN dr USING (s_idx, j_idx) JOIN rr USING (s_idx, j_idx)"


def _analytic(b: Binning):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return counts.analytic_counts(b, BOX, spark).select("s_idx", "j_idx", "s_min", "s_max", F.round("ncnt", 14).alias("ncnt"))

    rr = "2 * pi() * (j_max - j_min) * (s_max * s_max - s_min * s_min) / 1073741824.0" if b.scheme == "spi" else f"4 * pi() * (s_max * s_max * s_max - s_min * s_min * s_min) / ({3.0 * b.second} * 1073741824.0)"
    return run, f"WITH {', '.join(_bins_sql(b))} SELECT s_idx::INT AS s_idx, j_idx::INT AS j_idx, s_min, s_max, round({rr}, 14) AS ncnt FROM s_edges CROSS JOIN j_edges"


def _histogram(b: Binning):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return counts.distance_histogram(points(spark, sf_dir), None, b, BOX)

    return run, f"WITH {_points_sql('d')}, {', '.join(_bins_sql(b))}, {_count_sql('c', 'd', 'd', b, True)} SELECT s_idx, s_min, s_max, (cnt / 2)::BIGINT AS n FROM c"


# --- expressions and coordinates -----------------------------------------------------------------------------------


def _column(names: list[str]):
    return lambda v: F.col(names[int(v) - 1])


def catalog_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions, a weight and a selection in the expression language over (orderkey, custkey, totalprice, status)."""
    names = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"]
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(*names)
    types = {"1": "long", "2": "long", "3": "double", "4": "string"}
    chosen = orders.where(expr.as_bool(expr.parse("isfinite($3) && $3 > 1000 && $4 != 'F' && ($1 + $2) % 5 != 0"), _column(names), types.__getitem__))
    parts = {"id": F.col("o_orderkey").cast("long")} | {n: expr.as_double(expr.parse(e), _column(names)) for n, e in (("x", "($1 * 7919) % 1009"), ("y", "($1 * 104729) % 1013"), ("z", "abs(-$2) / 4"), ("w", "1 + $2 % 3"))}
    return chosen.select(*[c.alias(n) for n, c in parts.items()])


CATALOG_SQL = "SELECT o_orderkey::BIGINT AS id, ((o_orderkey::BIGINT * 7919) % 1009)::DOUBLE AS x, ((o_orderkey::BIGINT * 104729) % 1013)::DOUBLE AS y, o_custkey / 4.0::DOUBLE AS z, (1 + o_custkey % 3)::DOUBLE AS w FROM orders WHERE o_totalprice > 1000 AND o_orderstatus <> 'F' AND (o_orderkey + o_custkey) % 5 <> 0"


def selection_bitwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    types = {"1": "long", "2": "long"}
    chosen = parts.where(expr.as_bool(expr.parse("($1 & 5) != 0 && ($2 ^ 3) > 7 || ($1 >> 2) == ($2 << 1) || !($2 % 10)"), _column(["p_partkey", "p_size"]), types.__getitem__))
    return chosen.select(F.col("p_partkey").cast("long").alias("p_partkey"), F.col("p_size").cast("long").alias("p_size"))


BITWISE_SQL = "SELECT p_partkey::BIGINT AS p_partkey, p_size::BIGINT AS p_size FROM part WHERE ((p_partkey & 5) <> 0 AND xor(p_size, 3) > 7) OR (p_partkey >> 2) = (p_size::BIGINT << 1) OR p_size % 10 = 0"


def selection_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    types = {"1": "long", "2": "long"}
    chosen = parts.where(expr.as_bool(expr.parse("$1 < 40 || $1 >= 150 && $1 <= 170 || ($2 | 4) == 5 || (~$1 & 63) == 0 || sqrt($2) > 7 && $2 <= 49 || sqrt($2 + 0.0) == 3"), _column(["p_partkey", "p_size"]), types.__getitem__))
    root = expr.as_double(expr.parse("sqrt($1) * 2"), _column(["p_partkey", "p_size"]))
    return chosen.select(F.col("p_partkey").cast("long").alias("p_partkey"), F.col("p_size").cast("long").alias("p_size"), F.round(root, 9).alias("root"))


COMPARISONS_SQL = "SELECT p_partkey::BIGINT AS p_partkey, p_size::BIGINT AS p_size, round(sqrt(p_partkey) * 2, 9) AS root FROM part WHERE p_partkey < 40 OR (p_partkey >= 150 AND p_partkey <= 170) OR (p_size | 4) = 5 OR ((~p_partkey::BIGINT) & 63) = 0 OR (sqrt(p_size) > 7 AND p_size <= 49) OR sqrt(p_size) = 3"


def expr_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    forms = {"power_left": "2 ** 3 ** 2 + $1 - $1", "minus_first": "-2 ** 2 + $1 * 0", "mixed": "1 + $1 * 3 % 7 / 2 - 4", "logs": "log(100 + $1 * 0) + ln(1 + 0 * $1)", "nested": "abs(3 - $1) * (2 - $1 % 2)"}
    return supplier.select(F.col("s_suppkey").cast("long").alias("s_suppkey"), *[F.round(expr.as_double(expr.parse(e), _column(["s_suppkey"])), 9).alias(n) for n, e in forms.items()])


PRECEDENCE_SQL = "SELECT s_suppkey::BIGINT AS s_suppkey, 64.0::DOUBLE AS power_left, 4.0::DOUBLE AS minus_first, round(1 + ((s_suppkey * 3) % 7) / 2.0::DOUBLE - 4, 9) AS mixed, 2.0::DOUBLE AS logs, round(abs(3 - s_suppkey) * (2 - s_suppkey % 2), 9)::DOUBLE AS nested FROM supplier"


def _sky(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey").cast("long")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("id"), (k % 360).cast("double").alias("ra"), ((k * 7) % 121 - 60).cast("double").alias("dec"), (F.lit(0.0) + (k % 95) / F.lit(100.0)).alias("red"))


_SKY_SQL = "sky AS (SELECT o_orderkey::BIGINT AS id, (o_orderkey % 360)::DOUBLE AS ra, ((o_orderkey::BIGINT * 7) % 121 - 60)::DOUBLE AS dec, (o_orderkey % 95) / 100.0::DOUBLE AS red FROM orders)"
_CARTESIAN_SQL = "round(d * cos(radians(dec)) * cos(radians(ra)), 5) AS x, round(d * cos(radians(dec)) * sin(radians(ra)), 5) AS y, round(d * sin(radians(dec)), 5) AS z"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("id", *[F.round(c, 5).alias(c) for c in "xyz"])


def coord_convert_gl(spark: SparkSession, sf_dir: str) -> DataFrame:
    sky = _sky(spark, sf_dir)
    return _rounded(cosmology.to_cartesian(sky, "ra", "dec", COSMOLOGY.distance_column(F.col("red"), GL_ORDER)))


def coord_convert_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quadrature order is chosen from the table's redshifts and the relative error."""
    return _rounded(cosmology.convert(_sky(spark, sf_dir), "ra", "dec", "red", COSMOLOGY, CHOSEN_ERROR))


def _gl_sql(order: int = GL_ORDER) -> str:
    node, weight = np.polynomial.legendre.leggauss(order)
    rows = ", ".join(f"({float((n + 1) / 2)!r}::DOUBLE, {float(w)!r}::DOUBLE)" for n, w in zip(node, weight, strict=True))
    a = "(1 + red * t)"
    return f"WITH {_SKY_SQL}, nodes(t, wt) AS (VALUES {rows}), dist AS (SELECT id, ra, dec, red / 2 * sum(wt * {cosmology.HUBBLE_DISTANCE} / sqrt({COSMOLOGY.omega_m} * {a} * {a} * {a} + {COSMOLOGY.omega_l})) AS d FROM sky CROSS JOIN nodes GROUP BY id, ra, dec, red) SELECT id, {_CARTESIAN_SQL} FROM dist"


def coord_convert_spline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(cosmology.convert(_sky(spark, sf_dir), "ra", "dec", "red", cosmology.Spline(*KNOTS)))


def _spline_sql() -> str:
    s = cosmology.Spline(*KNOTS)
    rows = ", ".join(f"({', '.join(f'{v!r}::DOUBLE' for v in (*map(float, (s.z[i], s.z[i + 1], s.d[i], s.d[i + 1], s.second[i], s.second[i + 1])),))})" for i in range(len(s.z) - 1))
    value = "((z1 - red) * d0 + (red - z0) * d1) / (z1 - z0) + (((z1 - red) / (z1 - z0)) ** 3 - (z1 - red) / (z1 - z0)) * m0 * (z1 - z0) ** 2 / 6 + (((red - z0) / (z1 - z0)) ** 3 - (red - z0) / (z1 - z0)) * m1 * (z1 - z0) ** 2 / 6"
    return f"WITH {_SKY_SQL}, knots(z0, z1, d0, d1, m0, m1) AS (VALUES {rows}), dist AS (SELECT id, ra, dec, {value} AS d FROM sky JOIN knots ON red >= z0 AND red < z1) SELECT id, {_CARTESIAN_SQL} FROM dist"


_PAIRED = {
    "box_iso_dd": _counted(ISO, BOX),
    "box_iso_cross": _counted(ISO, BOX, cross=True),
    "box_iso_weighted": _counted(ISO, BOX, weighted=True),
    "box_smu_dd": _counted(SMU, BOX),
    "box_smu_cross_weighted": _counted(SMU, BOX, cross=True, weighted=True),
    "box_smu_mu_one": _counted(MU_ONE, BOX),
    "box_iso_one_sided": _counted(ISO, BOX, cross=True, weighted=True, one_sided=True),
    "box_spi_dd": _counted(SPI, BOX),
    "box_spi_cross": _counted(SPI, BOX, cross=True),
    "sv_iso_dd": _counted(ISO, None),
    "sv_smu_dd": _counted(SMU, None),
    "sv_spi_dd": _counted(SPI, None),
    "sv_smu_cross": _counted(SMU, None, cross=True),
    "sv_spi_weighted": _counted(SPI, None, weighted=True),
    "sv_weighted_norm": _counted(WIDE, None, cross=True, weighted=True),
    "custom_edges": _counted(CUSTOM, BOX),
    "box_analytic_rr_iso": _analytic(ISO),
    "box_analytic_rr_smu": _analytic(SMU),
    "box_analytic_rr_spi": _analytic(SPI),
    "box_natural_xi": _natural(ISO),
    "box_multipoles": _natural(WIDE_SMU, "multipoles"),
    "box_multipoles_all": _natural(WIDE_SMU, "multipoles", tuple(range(7))),
    "box_wp": _natural(WIDE_SPI, "wp"),
    "sv_landy_szalay": _landy_szalay(WIDE),
    "sv_landy_szalay_smu_weighted": _landy_szalay(WIDE_SMU, weighted=True),
    "distance_hist_lin": _histogram(Binning("iso", Edges.linear(0, 48, 6))),
    "distance_hist_log": _histogram(LOG),
    "catalog_select": (catalog_select, CATALOG_SQL),
    "selection_bitwise": (selection_bitwise, BITWISE_SQL),
    "selection_comparisons": (selection_comparisons, COMPARISONS_SQL),
    "expr_precedence": (expr_precedence, PRECEDENCE_SQL),
    "coord_convert_gl": (coord_convert_gl, _gl_sql()),
    "coord_convert_chosen": (coord_convert_chosen, _gl_sql(COSMOLOGY.order_for(0.0, 0.94, CHOSEN_ERROR))),
    "coord_convert_spline": (coord_convert_spline, _spline_sql()),
}

QUERIES = {name: pair[0] for name, pair in _PAIRED.items()}
ORACLES = {name: pair[1] for name, pair in _PAIRED.items()}
