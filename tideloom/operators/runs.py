"""Plans, samples and training rows of experiments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideloom.operators.prompts import token_estimate

# Bytes of a score.
_BYTES = {"float16": 2, "float32": 4, "float64": 8}


def score_tensor_mb(batch: int, candidates: int, dtype: str = "float32") -> float:
    return batch * candidates * _BYTES.get(dtype, 4) / (1 << 20)


def fitting_batch(batch: int, candidates: int, dtype: str, most_mb: float) -> int:
    """The batch, or as many rows as fit into the memory."""
    if candidates <= 0:
        raise ValueError("candidates must be positive")
    if score_tensor_mb(batch, candidates, dtype) <= most_mb:
        return batch
    rows = int(most_mb * (1 << 20) / _BYTES.get(dtype, 4)) // candidates
    if rows < 1:
        raise MemoryError("one row of scores is over the limit")
    return min(batch, rows)


def job_queue(datasets: DataFrame, methods: DataFrame, seeds: DataFrame) -> DataFrame:
    """Planned jobs: every dataset, method and seed; small driver-made tables."""
    return datasets.crossJoin(methods).crossJoin(seeds).withColumn("job_id", F.format_string("job_%s_%s_%d", "dataset", "method", "seed")).withColumn("status", F.lit("planned"))


def sample_cases(rows: DataFrame, group: str, per_group: int, seed: int = 0, key: str = "case_id") -> DataFrame:
    """Up to per_group cases of each group in hash order; a case in several groups counts for the first by name."""
    once = rows.groupBy(key).agg(F.min(group).alias(group))
    w = Window.partitionBy(group).orderBy(F.sha2(F.concat_ws("|", F.lit(seed), key), 256))
    return once.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_group)


def sft_rows(prefixes: DataFrame, system: str = "You recommend items.") -> DataFrame:
    """prefixes(event_id, user_id, item_id, history array) of training events -> chat rows as JSON."""
    asked = F.concat(F.lit("History: "), F.array_join(F.col("history").cast("array<string>"), ", "))
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return prefixes.select("event_id", F.to_json(F.struct(F.array(message("system", F.lit(system)), message("user", asked), message("assistant", F.col("item_id").cast("string"))).alias("messages"))).alias("row"))


def sft_leaks(rows: DataFrame, labelled: DataFrame) -> DataFrame:
    """Training rows whose event is not a training event: must be empty."""
    return rows.join(labelled.where("split = 'train'").select("event_id"), "event_id", "left_anti")


def mean_metrics(rows: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The mean of every numeric column by group."""
    numbers = [n for n, kind in rows.dtypes if n not in groups and kind in ("double", "float", "int", "bigint")]
    return rows.groupBy(*groups).agg(*[F.avg(n).alias(n) for n in numbers])


def preflight(prompts: DataFrame, max_tokens: int, max_calls: int, groups: Sequence[str] = ()) -> DataFrame:
    """prompts(groups, text) -> planned requests, estimated tokens each way, and whether they stay within the cap."""
    return prompts.groupBy(*groups).agg(F.count("*").alias("calls"), F.sum(token_estimate(F.col("text"))).alias("prompt_tokens"), (F.count("*") * max_tokens).alias("completion_tokens"), (F.count("*") <= max_calls).alias("within_cap"))


def assert_within_cap(prompts: DataFrame, max_calls: int) -> int:
    """The number of planned requests; an error if it is over the cap."""
    if max_calls <= 0:
        raise ValueError("max_calls must be positive")
    calls = prompts.count()
    if calls > max_calls:
        raise ValueError(f"{calls} planned requests are over the cap of {max_calls}")
    return calls


def main_table(aggregates: DataFrame, keys: Sequence[str], metrics: Sequence[str], marks: DataFrame | None = None) -> DataFrame:
    """aggregates(keys, metric, mean, std) -> one row a key with `mean +/- std` of each metric, and a * where marks(keys) has it."""
    shown = F.format_string("%.4f +/- %.4f", F.col("mean"), F.col("std"))
    wide = aggregates.groupBy(*keys).pivot("metric", list(metrics)).agg(F.first(shown))
    wide = wide.select(*keys, *[F.coalesce(m, F.lit("0.0000 +/- 0.0000")).alias(m) for m in metrics])
    if marks is None:
        return wide.withColumn("significant", F.lit(""))
    return wide.join(marks.select(*keys).distinct().withColumn("significant", F.lit("*")), list(keys), "left").withColumn("significant", F.coalesce("significant", F.lit("")))
