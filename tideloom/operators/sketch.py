"""Quantile sketches as rows: counts in geometric buckets, which add up over runs, days and machines.

A positive value lies in bucket ceil(log_gamma(value)) with gamma = (1 + error) / (1 - error); the middle of a bucket is
within `error` of every value in it. Values of zero or less are one bucket of their own. A sketch has one row a
group and bucket, so its size does not grow with the requests, and two sketches merge by adding their rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAST = -(1 << 31)  # the bucket of zero and less


def _gamma(error: float) -> float:
    if not 0 < error < 1:
        raise ValueError("error must lie between 0 and 1")
    return (1 + error) / (1 - error)


def sketch(values: DataFrame, groups: Sequence[str], value: str, error: float = 0.01) -> DataFrame:
    """(groups, bucket, n, total): counts and sums of the values by bucket; nulls are left out."""
    number = F.col(value).cast("double")
    bucket = F.when(number > 0, F.ceil(F.log(number) / math.log(_gamma(error)))).otherwise(LEAST).cast("int")
    return values.where(F.col(value).isNotNull()).groupBy(*groups, bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sum(number).alias("total"))


def merge(*sketches: DataFrame) -> DataFrame:
    """One sketch of all the values of several of one error and the same groups."""
    both = sketches[0]
    for more in sketches[1:]:
        both = both.unionByName(more)
    groups = [c for c in both.columns if c not in ("n", "total")]
    return both.groupBy(*groups).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def quantiles(sketched: DataFrame, groups: Sequence[str], asked: Sequence[float], error: float = 0.01) -> DataFrame:
    """(groups, quantile, estimate): within `error` of the least value that the quantile's share of values do not exceed."""
    gamma = _gamma(error)
    upto = Window.partitionBy(*groups).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sketched.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy(*groups)))
    each = placed.withColumn("quantile", F.explode(F.array(*[F.lit(float(q)) for q in asked])))
    reached = each.where(F.col("upto") >= F.greatest(F.ceil(F.col("quantile") * F.col("all")), F.lit(1)))
    middle = F.when(F.col("bucket") > LEAST, F.pow(F.lit(gamma), F.col("bucket")) * 2 / (gamma + 1)).otherwise(0.0)
    return reached.groupBy(*groups, "quantile").agg(F.min("bucket").alias("bucket")).select(*groups, "quantile", middle.alias("estimate"))


def summary(sketched: DataFrame, groups: Sequence[str], error: float = 0.01) -> DataFrame:
    """(groups, requests, mean, p50, p95, p99) of a sketch; the mean is exact."""
    names = {0.5: "p50", 0.95: "p95", 0.99: "p99"}
    found = quantiles(sketched, groups, list(names), error).groupBy(*groups).agg(*[F.max(F.when(F.col("quantile") == q, F.col("estimate"))).alias(n) for q, n in names.items()])
    counts = sketched.groupBy(*groups).agg(F.sum("n").alias("requests"), (F.sum("total") / F.sum("n")).alias("mean"))
    return counts.join(found, list(groups)) if groups else counts.crossJoin(found)
