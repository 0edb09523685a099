"""Evaluation of prediction rows: metrics by group, deltas and overlaps against a reference, recovered cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideloom.operators.metrics import rarest

KS = (1, 5, 10)


def rank_of_target(predicted: str = "predicted_items", target: str = "target_item", most: int = max(KS)) -> Column:
    """The target's place among the first `most` different predicted items; null where it is not there."""
    place = F.array_position(F.slice(F.array_distinct(predicted), 1, most), F.col(target))
    return F.when(place > 0, place)


def contributions(rows: DataFrame) -> DataFrame:
    """rows(..., predicted_items, target_item) with what each adds to recall_5, ndcg_5 and mrr_10."""
    place = F.when(F.array_position(F.slice("predicted_items", 1, 10), F.col("target_item")) > 0, F.array_position(F.slice("predicted_items", 1, 10), F.col("target_item")))
    return rows.withColumn("__r", place).withColumns({
        "recall_5": F.when(F.col("__r") <= 5, 1.0).otherwise(0.0),
        "ndcg_5": F.when(F.col("__r") <= 5, 1 / F.log2(F.col("__r") + 1)).otherwise(0.0),
        "mrr_10": F.coalesce(1 / F.col("__r"), F.lit(0.0)),
    }).drop("__r")


def accumulated(rows: DataFrame, items: DataFrame, train: DataFrame, sets: Sequence[Sequence[str]], tail_share: float = 0.2, top: int = 10, ks: Sequence[int] = KS) -> DataFrame:
    """rows(groups, target_item, predicted_items, candidate_items) -> one row of metrics for each group of each grouping set.

    Two aggregations over all sets at once: of the rows, for hits, NDCG and reciprocal ranks; and of their first
    `top` predicted items, for coverage, validity, long tail and novelty. `level` is Spark's grouping id. An item is
    invalid if the catalogue lacks it or, where the row names candidates, they do.
    """
    columns = list(dict.fromkeys(c for s in sets for c in s))
    groups = [F.col(c) for c in columns]
    keyed = [[F.col(c) for c in s] for s in sets]
    measures = [F.count("*").alias("num_predictions")]
    for k in ks:
        hit = F.coalesce(F.col("__r") <= k, F.lit(False))
        measures += [F.avg(hit.cast("double")).alias(f"recall_{k}"), F.avg(F.when(hit, 1 / F.log2(F.col("__r") + 1)).otherwise(0.0)).alias(f"ndcg_{k}"), F.avg(F.when(hit, 1 / F.col("__r")).otherwise(0.0)).alias(f"mrr_{k}")]
    ranked = rows.withColumn("__r", rank_of_target(most=max(ks))).groupingSets(keyed, *groups).agg(*measures, F.grouping_id().alias("level"))

    catalogue = items.select(F.col("item_id").cast("string").alias("item"), F.lit(True).alias("known")).distinct()
    counts = train.groupBy(F.col("item_id").cast("string").alias("item")).agg(F.count("*").alias("c"))
    base = counts.agg((F.coalesce(F.sum("c"), F.lit(0)) + F.count("*") + 1).alias("all")).first()["all"]
    tail = rarest(train, tail_share).select(F.col("item_id").cast("string").alias("item"), F.lit(1).alias("rare"))
    size = catalogue.count()
    known = catalogue.join(counts.join(tail, "item", "left"), "item", "full_outer")
    shown = rows.select(*columns, "candidate_items", F.explode(F.slice("predicted_items", 1, top)).alias("item")).join(known, "item", "left")
    outside = F.coalesce((F.size("candidate_items") > 0) & ~F.array_contains("candidate_items", F.col("item")), F.lit(False))
    invalid = F.col("known").isNull() | outside
    parts = shown.groupingSets(keyed, *groups).agg(
        F.count_distinct(F.when(F.col("known"), F.col("item"))).alias("item_coverage"),
        F.avg(invalid.cast("double")).alias("hallucination_rate"),
        F.avg(F.coalesce("rare", F.lit(0)).cast("double")).alias("long_tail_ratio"),
        F.avg(-F.log2((F.coalesce("c", F.lit(0)) + 1) / F.lit(base))).alias("novelty"),
        F.grouping_id().alias("level"),
    )
    same = F.lit(True)
    for c in [*columns, "level"]:
        same &= ranked[c].eqNullSafe(parts[c])
    joined = ranked.join(parts, same, "left")
    zero = lambda c: F.coalesce(parts[c], F.lit(0.0)).alias(c)
    return joined.select(*[ranked[c] for c in [*columns, "level", "num_predictions"]], *[ranked[m.format(k)] for k in ks for m in ("recall_{}", "ndcg_{}", "mrr_{}")], F.coalesce("item_coverage", F.lit(0)).alias("item_coverage"), (F.coalesce("item_coverage", F.lit(0)) / F.lit(max(1, size))).alias("coverage"), zero("hallucination_rate"), (1 - F.coalesce("hallucination_rate", F.lit(0.0))).alias("validity_rate"), zero("long_tail_ratio"), zero("novelty"))


def against_reference(metrics: DataFrame, variant: str, reference: str, names: Sequence[str]) -> DataFrame:
    """metrics(variant, names) -> each variant's differences from the reference's row."""
    base = metrics.where(F.col(variant) == reference).select(*[F.col(n).alias(f"__{n}") for n in names])
    return metrics.crossJoin(F.broadcast(base)).select(variant, *[(F.col(n) - F.col(f"__{n}")).alias(f"delta_{n}") for n in names])


def case_changes(rows: DataFrame, keys: Sequence[str], variant: str, reference: str, k: int = 5) -> DataFrame:
    """rows(keys, variant, predicted_items) -> each case's overlap of its first k items with the reference's, 1 where both are empty, and whether it changed."""
    cut = F.array_distinct(F.slice("predicted_items", 1, k))
    base = rows.where(F.col(variant) == reference).select(*keys, cut.alias("__b"))
    joined = rows.where(F.col(variant) != reference).select(*keys, variant, cut.alias("__a")).join(base, list(keys))
    every = F.size(F.array_union("__a", "__b"))
    return joined.select(*keys, variant, F.when(every > 0, F.size(F.array_intersect("__a", "__b")) / every).otherwise(1.0).alias("overlap")).withColumn("output_changed", F.col("overlap") < 1)


def change_rates(changes: DataFrame, variant: str) -> DataFrame:
    """case_changes() -> compared cases, mean overlap and output change rate of each variant."""
    return changes.groupBy(variant).agg(F.count("*").alias("compared"), F.avg("overlap").alias("mean_overlap"), (1 - F.avg("overlap")).alias("output_change_rate"))


def recovered(base: DataFrame, other: DataFrame, keys: Sequence[str], k: int = 5) -> DataFrame:
    """base and other(keys, rank): cases of both, and those that base misses at k and other hits."""
    joined = base.select(*keys, F.col("rank").alias("a")).join(other.select(*keys, F.col("rank").alias("b")), list(keys))
    missed = F.col("a").isNull() | (F.col("a") > k)
    return joined.agg(F.count("*").alias("compared"), F.count_if(missed & F.coalesce(F.col("b") <= k, F.lit(False))).alias("recovered"))


def strongest(deltas: DataFrame, variant: str, reference: str, names: Sequence[str]) -> DataFrame:
    """The variant of largest absolute difference in any of the names, ties by name of the variant."""
    effect = F.greatest(*[F.abs(F.col(f"delta_{n}")) for n in names]) if len(names) > 1 else F.abs(F.col(f"delta_{names[0]}"))
    return deltas.where(F.col(variant) != reference).withColumn("absolute_effect", effect).orderBy(F.desc("absolute_effect"), variant).limit(1)
