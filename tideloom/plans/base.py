"""Shared inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideloom.operators import graph, splits
from tideloom.sources.tables import event_interactions, part_items


def split_events(spark: SparkSession, folder: str) -> DataFrame:
    return splits.leave_one_out(event_interactions(spark, folder))


def train_events(spark: SparkSession, folder: str) -> DataFrame:
    return split_events(spark, folder).where("split = 'train'")


def test_cases(spark: SparkSession, folder: str) -> DataFrame:
    return split_events(spark, folder).where("split = 'test'")


def train_edges(spark: SparkSession, folder: str) -> DataFrame:
    return graph.tdig_edges(graph.transitions(train_events(spark, folder)))


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """Parts that the event log names."""
    items = event_interactions(spark, folder).select("item_id").distinct()
    return part_items(spark, folder).join(items, "item_id", "left_semi")


def rounded(frame: DataFrame, *but: str) -> DataFrame:
    """Doubles at six places, so that the order of summing does not show."""
    return frame.select(*[F.round(c, 6).alias(c) if kind == "double" and c not in but else F.col(c) for c, kind in frame.dtypes])
