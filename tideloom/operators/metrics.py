"""Ranking, coverage, novelty, diversity, validity and segment metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideloom.functions.text import jaccard


def ranking(ranks: DataFrame, ks: Sequence[int] = (1, 5, 10), groups: Sequence[str] = ()) -> DataFrame:
    """Mean hit rate, NDCG and MRR of a rank column, null being a miss; overall and by each group column, in one pass."""
    measures = [F.count("*").alias("cases")]
    for k in ks:
        hit = F.coalesce((F.col("rank") <= k), F.lit(False))
        measures += [F.avg(hit.cast("double")).alias(f"hr_{k}"), F.avg(F.when(hit, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias(f"ndcg_{k}"), F.avg(F.when(hit, 1 / F.col("rank")).otherwise(0.0)).alias(f"mrr_{k}")]
    if not groups:
        return ranks.agg(*measures)
    columns = [F.col(g) for g in groups]
    return ranks.groupingSets([[]] + [[c] for c in columns], *columns).agg(*measures)


def history_bucket(n: Column) -> Column:
    return F.when(n == 0, "0").when(n < 5, "1-4").when(n < 20, "5-19").when(n < 100, "20-99").otherwise("100+")


def short_history_bucket(n: Column) -> Column:
    return F.when(n == 0, "empty").when(n <= 2, "1_2").when(n <= 5, "3_5").when(n <= 10, "6_10").otherwise("gt_10")


def gap_segment(gap: Column) -> Column:
    day = 86_400
    return F.when(gap.isNull(), "unknown").when(gap <= day, "<=1d").when(gap <= 7 * day, "<=7d").when(gap <= 30 * day, "<=30d").otherwise(">30d")


def popularity_segment(count: Column) -> Column:
    c = F.coalesce(count, F.lit(0))
    return F.when(c == 0, "unseen").when(c <= 1, "tail").when(c <= 5, "mid").otherwise("head")


def catalogue_coverage(predictions: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """Distinct catalogue items among predictions at rank k or better, and their share."""
    catalogue = items.select("item_id").distinct()
    hit = predictions.where(F.col("rank") <= k).select("item_id").distinct().join(catalogue, "item_id", "left_semi").agg(F.count("*").alias("predicted"))
    return hit.crossJoin(catalogue.agg(F.count("*").alias("items"))).select("predicted", "items", (F.col("predicted") / F.col("items")).alias("coverage"))


def novelty(predictions: DataFrame, train: DataFrame) -> DataFrame:
    """Mean -log2 of the smoothed share of training events: (count + 1) / (events + items with events + 1)."""
    counts = train.groupBy("item_id").agg(F.count("*").alias("c"))
    base = counts.agg((F.sum("c") + F.count("*") + 1).alias("all"))
    joined = predictions.join(counts, "item_id", "left").crossJoin(F.broadcast(base))
    return joined.agg(F.avg(-F.log2((F.coalesce("c", F.lit(0)) + 1) / F.col("all"))).alias("novelty"), F.count("*").alias("predictions"))


def rarest(train: DataFrame, share: float = 0.2) -> DataFrame:
    """(item_id): the least popular share of the items with training events (rounded half to even, one at least), ties by id as text."""
    counted = train.groupBy("item_id").agg(F.count("*").alias("c"))
    return counted.orderBy("c", F.col("item_id").cast("string")).limit(max(1, round(share * counted.count()))).select("item_id")


def long_tail(predictions: DataFrame, train: DataFrame, share: float = 0.2) -> DataFrame:
    """Share of predictions among the rarest() items."""
    joined = predictions.join(rarest(train, share).withColumn("t", F.lit(1)), "item_id", "left")
    return joined.agg(F.count("*").alias("predictions"), F.coalesce(F.sum("t"), F.lit(0)).alias("in_tail"), F.coalesce(F.avg(F.coalesce("t", F.lit(0)).cast("double")), F.lit(0.0)).alias("long_tail_ratio"))


def bucket_shares(predictions: DataFrame, train: DataFrame) -> DataFrame:
    """Predictions by popularity bucket of their item."""
    counts = train.groupBy("item_id").agg(F.count("*").alias("c"))
    tagged = predictions.join(counts, "item_id", "left").groupBy(popularity_segment(F.col("c")).alias("bucket")).agg(F.count("*").alias("n"))
    return tagged.select("bucket", "n", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))).alias("share"))


def diversity(lists: DataFrame, keys: Sequence[str], tokens: str = "tokens") -> DataFrame:
    """Mean 1 - Jaccard over the pairs of each list; lists are short (a top-k), pairs stay within a row."""
    rows = lists.groupBy(*keys).agg(F.collect_list(tokens).alias("t"))
    pair = F.flatten(F.transform("t", lambda a, i: F.transform(F.slice("t", i + 2, F.greatest(F.size("t") - i - 1, F.lit(0))), lambda b: 1 - jaccard(a, b))))
    return rows.select(*keys, F.when(F.size(pair) > 0, F.aggregate(pair, F.lit(0.0), lambda s, x: s + x) / F.size(pair)).otherwise(0.0).alias("diversity"))


def validity(predictions: DataFrame, items: DataFrame, candidates: DataFrame | None = None, keys: Sequence[str] = ("event_id",)) -> DataFrame:
    """Predicted items that are in the catalogue and, where given, among the case's candidates; 1 and 0 when nothing is predicted."""
    known = predictions.join(items.select("item_id").distinct().withColumn("__c", F.lit(True)), "item_id", "left")
    if candidates is not None:
        known = known.join(candidates.select(*keys, "item_id").distinct().withColumn("__k", F.lit(True)), [*keys, "item_id"], "left")
    else:
        known = known.withColumn("__k", F.lit(True))
    good = F.count_if(F.col("__c") & F.col("__k"))
    return known.agg(F.count("*").alias("predicted"), good.alias("valid"), F.count_if(F.col("__k")).alias("adherent")).select("predicted", "valid", F.when(F.col("predicted") > 0, F.col("valid") / F.col("predicted")).otherwise(1.0).alias("validity_rate"), F.when(F.col("predicted") > 0, 1 - F.col("valid") / F.col("predicted")).otherwise(0.0).alias("hallucination_rate"), F.when(F.col("predicted") > 0, F.col("adherent") / F.col("predicted")).otherwise(1.0).alias("adherence_rate"))


def latency(rows: DataFrame, column: str, groups: Sequence[str] = ()) -> DataFrame:
    """Count, mean, median, interpolated and nearest-rank 95th percentile."""
    v = F.col(column)
    return rows.groupBy(*groups).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.percentile(v, F.lit(0.95)).alias("p95"), F.percentile_disc(0.95, v).alias("p95_nearest") if hasattr(F, "percentile_disc") else F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {column})").alias("p95_nearest"))
