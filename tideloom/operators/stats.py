"""Deltas, overlaps, paired tests and multi-seed aggregates."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def deltas(metrics: DataFrame, variant: str, baseline: str, keys: Sequence[str]) -> DataFrame:
    """metrics(keys, variant, metric, value): value less the baseline's, and the relative loss."""
    base = metrics.where(F.col(variant) == baseline).select(*keys, "metric", F.col("value").alias("base"))
    joined = metrics.where(F.col(variant) != baseline).join(base, [*keys, "metric"])
    return joined.select(*keys, variant, "metric", "value", "base", (F.col("value") - F.col("base")).alias("delta"), F.when(F.col("base") != 0, (F.col("base") - F.col("value")) / F.col("base")).otherwise(0.0).alias("sensitivity"))


def overlap(left: DataFrame, right: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Jaccard of two top-k sets of each key, 1 where both are empty, and Pearson's correlation of the ranks of common items (null for fewer than two, 0 if degenerate)."""
    a = left.where(F.col("rank") <= k).select(*keys, "item_id", F.col("rank").alias("ra"))
    b = right.where(F.col("rank") <= k).select(*keys, "item_id", F.col("rank").alias("rb"))
    both = a.join(b, [*keys, "item_id"], "full_outer").groupBy(*keys).agg(F.count("*").alias("n_union"), F.count_if(F.col("ra").isNotNull() & F.col("rb").isNotNull()).alias("common"), *[F.sum(F.when(F.col("ra").isNotNull() & F.col("rb").isNotNull(), e)).alias(n) for n, e in (("sa", F.col("ra")), ("sb", F.col("rb")), ("saa", F.col("ra") * F.col("ra")), ("sbb", F.col("rb") * F.col("rb")), ("sab", F.col("ra") * F.col("rb")))])
    n = F.col("common")
    var = (n * F.col("saa") - F.col("sa") * F.col("sa")) * (n * F.col("sbb") - F.col("sb") * F.col("sb"))
    corr = F.when(n < 2, F.lit(None).cast("double")).when(var == 0, 0.0).otherwise((n * F.col("sab") - F.col("sa") * F.col("sb")) / F.sqrt(var.cast("double")))
    return both.select(*keys, (F.col("common") / F.col("n_union")).alias("overlap"), corr.alias("rank_correlation"))


def paired_moments(pairs: DataFrame, groups: Sequence[str]) -> DataFrame:
    """pairs(groups, a, b) -> n, mean difference, sample variance, t and direction."""
    d = F.col("a") - F.col("b")
    sums = pairs.groupBy(*groups).agg(F.count("*").alias("n"), F.sum(d).alias("s"), F.sum(d * d).alias("ss"))
    mean = F.col("s") / F.col("n")
    variance = F.when(F.col("n") > 1, F.greatest((F.col("ss") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1), F.lit(0.0))).otherwise(0.0)
    t = F.when(F.col("variance") > 0, F.col("mean_delta") / F.sqrt(F.col("variance") / F.col("n"))).otherwise(F.when(F.col("mean_delta") == 0, 0.0).otherwise(F.signum("mean_delta") * float("inf")))
    found = sums.select(*groups, "n", mean.alias("mean_delta"), variance.alias("variance"))
    return found.withColumn("t", t).withColumn("direction", F.when(F.col("mean_delta") > 0, "improved").when(F.col("mean_delta") < 0, "degraded").otherwise("tied"))


def normal_p(t: float) -> float:
    """Two-sided p of a t value by the normal approximation."""
    return math.erfc(abs(t) / math.sqrt(2)) if math.isfinite(t) else 0.0


#: Sums of the Poisson(1) distribution up to each count; what lies beyond the last is below 1e-16.
_POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(18)]


def resampled(pairs: DataFrame, groups: Sequence[str], rounds: int = 1000, seed: int = 0) -> DataFrame:
    """Sign-flip p and 95 % bootstrap interval of the mean difference, by group.

    Round r's signs and Poisson(1) weights hash (seed, round, row) alone, so every task adds up its own rows and
    only `rounds` sums a group are shuffled. pairs(groups, row, a, b).
    """
    drawn = F.xxhash64(F.lit(seed).cast("long"), F.col("round").cast("long"), F.col("row").cast("long"))
    each = pairs.select(*groups, "row", (F.col("a") - F.col("b")).alias("d"), F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round")).withColumn("h", drawn)
    share = F.shiftrightunsigned("h", 11) / float(1 << 53)
    weight = F.lit(len(_POISSON))
    for k in range(len(_POISSON) - 1, -1, -1):
        weight = F.when(F.col("u") < _POISSON[k], k).otherwise(weight)
    signs = each.withColumn("u", share).select(*groups, "round", "d", (F.pmod("h", F.lit(2)) * 2 - 1).alias("sign"), weight.alias("w"))
    sums = signs.groupBy(*groups, "round").agg(F.sum(F.col("sign") * F.col("d")).alias("flip"), F.sum(F.col("w") * F.col("d")).alias("boot"), F.sum("w").alias("weight"), F.sum("d").alias("total"))
    extreme = F.count_if(F.abs("flip") >= F.abs(F.col("total")) - 1e-12)
    mean = F.when(F.col("weight") > 0, F.col("boot") / F.col("weight"))
    return sums.groupBy(*groups).agg(((extreme + 1) / (F.count("*") + 1)).alias("p_randomization"), F.percentile(mean, F.lit(0.025)).alias("ci_low"), F.percentile(mean, F.lit(0.975)).alias("ci_high"))


def paired_t_test(pairs: DataFrame, groups: Sequence[str]) -> DataFrame:
    """paired_moments() with the two-sided p of the normal approximation. One row a group reaches Python."""

    @F.pandas_udf("double")
    def p_of(t: pd.Series) -> pd.Series:
        return t.map(normal_p)

    return paired_moments(pairs, groups).withColumn("p_value", p_of("t"))


def multiseed(rows: DataFrame, keys: Sequence[str], seeds: Sequence[int]) -> DataFrame:
    """rows(keys, seed, metric, value) -> mean, sample deviation (0 for one) and the seeds that are missing."""
    found = rows.groupBy(*keys, "metric").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.count("*").alias("n"), F.collect_set(F.col("seed").cast("int")).alias("have"))
    missing = F.array_sort(F.array_except(F.array(*[F.lit(int(s)) for s in seeds]), F.col("have")))
    return found.select(*keys, "metric", "mean", "std", "n", F.array_join(missing.cast("array<string>"), ",").alias("missing_seeds"))


def best_rows(rows: DataFrame, groups: Sequence[str], metric: str, order: Sequence[str]) -> DataFrame:
    """The first row of the highest metric in each group."""
    w = Window.partitionBy(*groups).orderBy(F.desc(metric), *order)
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
