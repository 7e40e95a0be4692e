"""A whole run: catalogues, pair counts, correlation functions and their files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import cosmology, expr
from orrery.operators import counts, estimators
from orrery.operators.pairs import catalog as as_catalog
from orrery.plans.config import Catalog, Run
from orrery.sinks import results
from orrery.sources import ascii, fits, hdf5

_TYPES = {"boolean": "bool", "tinyint": "long", "smallint": "long", "int": "long", "bigint": "long", "float": "double", "double": "double", "string": "string"}


def load(spark: SparkSession, c: Catalog, run: Run) -> DataFrame:
    """A configured catalogue as (id, x, y, z, w): selected, projected, and moved to comoving positions if asked."""
    trees = [expr.parse(p) for p in c.position]
    weight = expr.parse(c.weight) if c.weight else None
    chosen = expr.parse(c.selection) if c.selection else None
    used = list(dict.fromkeys(v for t in (*trees, weight, chosen) if t for v in expr.variables(t)))
    names: dict[str, str] = {}
    if c.kind == 0:
        raw = ascii.read_ascii(spark, c.path, c.formatter, skip=c.skip, comment=c.comment, used={int(u) for u in used} or None)
        names = {u: f"c{u}" for u in used}
    elif c.kind == 1:
        raw = fits.read_fits(spark, c.path, used)
        names = {u: next(n for n in raw.columns if n.lower() == u.lower()) for u in used}
    elif c.kind == 2:
        raw = hdf5.read_hdf5(spark, c.path, used)
        names = {u: f"c{n + 1}" for n, u in enumerate(used)}
    else:
        raw = spark.read.parquet(c.path)
        names = {u: u for u in used}
    kinds = {f.name: _TYPES.get(f.dataType.simpleString(), "double") for f in raw.schema.fields}
    column = lambda v: F.col(f"`{names[v]}`")
    if chosen:
        raw = raw.where(expr.as_bool(chosen, column, lambda v: kinds[names[v]]))
    parts = [expr.as_double(t, column).alias(n) for t, n in zip(trees, ("p0", "p1", "p2"), strict=True)]
    out = raw.select(*parts, (expr.as_double(weight, column) if weight else F.lit(1.0)).alias("w"))
    if c.convert and not run.box:
        how = cosmology.Spline(*map(list, zip(*ascii.read_table(spark, run.knots), strict=True))) if run.knots else run.cosmology
        out = cosmology.convert(out, "p0", "p1", "p2", how, run.error)
    else:
        out = out.withColumnsRenamed({"p0": "x", "p1": "y", "p2": "z"})
    return as_catalog(out, w="w").persist()


def execute(spark: SparkSession, run: Run, say=print) -> dict[str, DataFrame]:
    """Counts, estimates and writes all that a run asks for; returns its tables by pair label and output file."""
    loaded: dict[str, tuple[DataFrame, tuple[int, float]]] = {}
    # a catalogue has weights if it is given any; a pair is weighted if either side is
    weighted = {p: any(x in run.catalogs and run.catalogs[x].weight for x in p) for p in run.pairs}

    def get(label: str) -> tuple[DataFrame, tuple[int, float]]:
        if label not in loaded:
            df = load(spark, run.catalogs[label], run)
            size = counts.totals(df)
            if not size[0]:
                raise ValueError(f"catalogue {label} has no rows")
            loaded[label] = df, size
        return loaded[label]

    out: dict[str, DataFrame] = {}
    tables: dict[str, DataFrame] = {}
    for pair, path in run.pairs.items():
        if not results.may_write(path, run.overwrite, True) if os.path.exists(path) and all(x in run.catalogs for x in pair) else os.path.exists(path):
            tables[pair] = results.pair_table(spark, path, run.binning, run.box)
            continue
        a, auto = get(pair[0]), pair[0] == pair[1]
        b = None if auto else get(pair[1])
        found = counts.pair_counts(a[0], None if auto else b[0], run.binning, run.box, weighted=weighted[pair], sizes=(a[1], b and b[1])).persist()
        numbers = tuple(s[1] if weighted[pair] else s[0] for s in (a[1], *([] if auto else [b[1]])))
        if run.text:
            results.write_pairs_text(found, path, run.binning, numbers, weighted[pair])
        else:
            results.write_pairs_binary(found, path, run.binning, run.box, numbers, weighted[pair])
        tables[pair] = found
        if run.verbose:
            say(f"{pair}: {numbers} -> {path}")
    for df, _ in loaded.values():
        df.unpersist()
    if run.box:
        tables[estimators.ANALYTIC] = counts.analytic_counts(run.binning, run.box, spark)
    out |= tables
    for n, (estimator, path) in enumerate(run.estimators):
        xi = estimators.estimate(tables, estimator)
        if results.may_write(path, run.overwrite, False):
            results.write_xi(xi, path, run.binning)
        out[path] = xi
        if run.multipoles and results.may_write(run.multipole_files[n], run.overwrite, False):
            out[run.multipole_files[n]] = m = estimators.multipoles(xi, run.multipoles, run.binning.n_mu)
            results.write_multipoles(m, run.multipole_files[n])
        if run.projected_files and results.may_write(run.projected_files[n], run.overwrite, False):
            out[run.projected_files[n]] = w = estimators.projected(xi)
            results.write_projected(w, run.projected_files[n])
    return out
