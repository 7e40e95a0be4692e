"""Pairs of arriving points with a fixed catalogue, counted as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators.bins import Binning
from orrery.operators.pairs import Box, pairs


def streamed_cross_counts(arriving: DataFrame, fixed: DataFrame, binning: Binning, box: Box | None = None, weighted: bool = False) -> DataFrame:
    """Running counts by bin of a streaming catalogue against a static one, for complete or update output.

    The join is stateless on the static side and the state has one row per bin.
    """
    found = pairs(arriving, fixed, binning, box)
    return found.groupBy("s_idx", "j_idx").agg((F.sum("w") if weighted else F.count("*")).alias("cnt"))
