"""Pair counts: pairs summed by bin, normalised, with every bin present."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import ieee
from orrery.operators.bins import Binning
from orrery.operators.pairs import Box, pair_sums


def totals(df: DataFrame) -> tuple[int, float]:
    """(rows, sum of weights) of a catalogue."""
    n, w = df.agg(F.count("*"), F.sum("w")).first()
    return n, w or 0.0


def norm(left: tuple[int, float], right: tuple[int, float] | None, weighted: bool) -> float:
    """What counts are divided by: N (N - 1) or W (W - 1) within a catalogue, N1 N2 or W1 W2 between two."""
    i = 1 if weighted else 0
    return float(left[i] * (left[i] - 1)) if right is None else float(left[i] * right[i])


def pair_counts(left: DataFrame, right: DataFrame | None, binning: Binning, box: Box | None = None, *, weighted: bool = False, sizes: tuple | None = None) -> DataFrame:
    """Dense counts by bin: the columns of Binning.table with cnt (long, or double if weighted), norm and ncnt.

    Pairs within one catalogue count twice. sizes: totals() of both sides, where they are known; else they are counted.
    """
    spark = left.sparkSession
    sizes = sizes or (totals(left), None if right is None else totals(right))
    times = 2 if right is None else 1
    summed = pair_sums(left, right, binning, box, not weighted, weighted).select("s_idx", "j_idx", (F.col("w" if weighted else "n") * times).alias("found"))
    dense = binning.table(spark).join(summed, ["s_idx", "j_idx"], "left")
    zero = F.lit(0.0) if weighted else F.lit(0).cast("long")
    return normalised(dense.withColumn("cnt", F.coalesce("found", zero)).drop("found"), norm(*sizes, weighted))


def normalised(df: DataFrame, by: float) -> DataFrame:
    return df.withColumn("norm", F.lit(by)).withColumn("ncnt", ieee.divide(F.col("cnt").cast("double"), F.col("norm")))


def analytic_counts(binning: Binning, box: Box, spark) -> DataFrame:
    """Normalised counts (ncnt) of a uniform box: the volume of a bin over that of the box."""
    table = binning.table(spark)
    cube = lambda c: F.col(c) * F.col(c) * F.col(c)
    volume = F.lit(box.x * box.y * box.z)
    if binning.scheme == "spi":
        ring = F.col("s_max") * F.col("s_max") - F.col("s_min") * F.col("s_min")
        part: Column = F.lit(2 * math.pi) * (F.col("j_max") - F.col("j_min")) * ring / volume
    else:
        part = F.lit(4 * math.pi) * (cube("s_max") - cube("s_min")) / (F.lit(3.0 * binning.second) * volume)
    return table.withColumn("ncnt", part)


def distance_histogram(left: DataFrame, right: DataFrame | None, binning: Binning, box: Box | None = None) -> DataFrame:
    """Pairs by distance, each once: s_idx, s_min, s_max, n."""
    summed = pair_sums(left, right, binning, box, weighted=False).groupBy("s_idx").agg(F.sum("n").alias("found"))
    return binning.table(left.sparkSession).join(summed, "s_idx", "left").select("s_idx", "s_min", "s_max", F.coalesce("found", F.lit(0)).alias("n"))
