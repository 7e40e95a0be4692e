"""Spark-native two-point statistics of 3-D point catalogues."""

__version__ = "0.1.0"
