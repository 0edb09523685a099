"""Rows of equal keys in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def together(frame: DataFrame, *keys: str) -> DataFrame:
    """The rows of equal keys in one partition, for functions that walk whole partitions.

    Not repartition(*keys): where the rows lie by the keys already, Spark leaves that exchange out, and later deals
    the two sides of a union to unequal numbers of tasks or splits a skewed join, since such functions require nothing.
    """
    return frame.repartition(F.xxhash64(*keys))
