"""Temporal splits and their leakage checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("ts", "event_id")


def leave_one_out(interactions: DataFrame, order: Sequence[str] = ORDER, minimum: int = 3) -> DataFrame:
    """Each user's last row is test, the one before val, the rest train. Users with fewer than `minimum` rows raise at run time."""
    back = Window.partitionBy("user_id").orderBy(*[F.col(c).desc_nulls_last() for c in order])
    size = F.count("*").over(Window.partitionBy("user_id"))
    ranked = interactions.withColumn("__b", F.row_number().over(back)).withColumn("__n", size)
    label = F.when(F.col("__n") < minimum, F.raise_error(F.lit("a user has too few events for leave-one-out"))).when(F.col("__b") == 1, "test").when(F.col("__b") == 2, "val").otherwise("train")
    return ranked.withColumn("split", label).drop("__b", "__n")


def _cut_times(interactions: DataFrame, positions: list[int]) -> list[int | None]:
    """The times at 0-based positions of the sorted times, from counts of distinct times by range partition."""
    ordered = interactions.groupBy("ts").count().where("ts is not null").repartitionByRange("ts").withColumn("__p", F.spark_partition_id())
    sums = sorted((r["__p"], r["n"]) for r in ordered.groupBy("__p").agg(F.sum("count").alias("n")).collect())
    before, starts = 0, []
    for p, n in sums:
        starts.append((p, before, n))
        before += n
    found: list[int | None] = []
    for position in positions:
        place = next(((p, b) for p, b, n in starts if b <= position < b + n), None)
        if place is None:
            found.append(None)
            continue
        running = F.sum("count").over(Window.partitionBy("__p").orderBy("ts"))
        row = ordered.where(F.col("__p") == place[0]).withColumn("__c", running + place[1]).where(F.col("__c") > position).agg(F.min("ts")).first()
        found.append(row[0])
    return found


def global_time(interactions: DataFrame, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """Cut-off times at the positions train and train + val of the sorted rows; ties go to the later side."""
    n = interactions.count()
    first, second = _cut_times(interactions, [int(n * train), int(n * (train + val))])
    label = F.when(F.col("ts") < F.lit(first), "train").when(F.col("ts") < F.lit(second), "val").otherwise("test")
    return interactions.withColumn("split", label)


def positional(numbered: DataFrame, place: str, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """By 0-based place alone; ties may straddle."""
    n = numbered.count()
    label = F.when(F.col(place) < int(n * train), "train").when(F.col(place) < int(n * (train + val)), "val").otherwise("test")
    return numbered.withColumn("split", label)


def as_of(interactions: DataFrame, time: int, strict: bool = True) -> DataFrame:
    """Training rows known at a time."""
    return interactions.where((F.col("split") == "train") & ((F.col("ts") < time) if strict else (F.col("ts") <= time)))


def user_leaks(labelled: DataFrame) -> DataFrame:
    """Users with a row of an earlier split after one of a later: must be empty."""
    edges = labelled.groupBy("user_id").agg(*[f(F.when(F.col("split") == s, F.col("ts"))).alias(n) for n, s, f in (("train_max", "train", F.max), ("val_min", "val", F.min), ("val_max", "val", F.max), ("test_min", "test", F.min))])
    return edges.where("train_max > val_min or val_max > test_min or train_max > test_min")


def global_leaks(labelled: DataFrame) -> DataFrame:
    """The same over all users: one row if the splits overlap in time."""
    edges = labelled.agg(*[f(F.when(F.col("split") == s, F.col("ts"))).alias(n) for n, s, f in (("train_max", "train", F.max), ("val_min", "val", F.min), ("val_max", "val", F.max), ("test_min", "test", F.min))])
    return edges.where("train_max >= val_min or val_max >= test_min")


def summary(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("split").agg(F.count("*").alias("rows"), F.count_distinct("user_id").alias("users"), F.count_distinct("item_id").alias("items"))
