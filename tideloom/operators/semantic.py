"""Item-text overlap against transitions: pairs, case labels and hard negatives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideloom.functions.cuts import cut
from tideloom.functions.text import item_tokens
from tideloom.operators.prep import numbered


def token_index(items: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(item_id, token), one row for each distinct token of the item's text columns."""
    text = F.concat_ws(" ", *columns)
    return items.select("item_id", F.explode(item_tokens(text)).alias("token")).distinct()


def overlap_pairs(index: DataFrame, left: DataFrame | None = None) -> DataFrame:
    """Pairs of different items that share a token: (item_id, other_id, shared, jaccard). The join is on the token; `left` limits one side to the items asked about."""
    sizes = index.groupBy("item_id").agg(F.count("*").alias("n"))
    asked = index if left is None else index.join(left.select("item_id").distinct(), "item_id", "left_semi")
    other = index.select(F.col("item_id").alias("other_id"), "token")
    shared = asked.join(other, "token").where("item_id <> other_id").groupBy("item_id", "other_id").agg(F.count("*").alias("shared"))
    joined = shared.join(sizes, "item_id").join(sizes.select(F.col("item_id").alias("other_id"), F.col("n").alias("m")), "other_id")
    return joined.select("item_id", "other_id", "shared", (F.col("shared") / (F.col("n") + F.col("m") - F.col("shared"))).alias("jaccard"))


def against_transitions(pairs: DataFrame, edges: DataFrame, categories: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """All ordered item pairs with text similarity or transitions, and their groups."""
    joined = pairs.select(F.col("item_id").alias("source_id"), F.col("other_id").alias("target_id"), "jaccard").join(edges.where("source_id <> target_id").select("source_id", "target_id", "support"), ["source_id", "target_id"], "full_outer")
    rows = joined.select("source_id", "target_id", F.coalesce("jaccard", F.lit(0.0)).alias("similarity"), F.coalesce("support", F.lit(0)).alias("transition_count"))
    semantic, moved = F.col("similarity") >= threshold, F.col("transition_count") > 0
    rows = rows.withColumn("case_group", F.when(semantic & moved, "semantic_and_transition").when(semantic, "semantic_only").when(moved, "transition_only").otherwise("neither"))
    if categories is None:
        return rows
    a = categories.select(F.col("item_id").alias("source_id"), F.col("category").alias("ca"))
    b = categories.select(F.col("item_id").alias("target_id"), F.col("category").alias("cb"))
    same = F.coalesce(F.col("ca") == F.col("cb"), F.lit(False))
    return rows.join(a, "source_id", "left").join(b, "target_id", "left").withColumn("category_group", F.when(~moved, F.lit(None)).when(same, "same_category_transition").otherwise("cross_category_transition")).drop("ca", "cb")


def case_labels(cases: DataFrame, sources: DataFrame, index: DataFrame, target_ranks: DataFrame) -> DataFrame:
    """Each case's largest token overlap with a source, its source (the most recent of equals) and one of five labels."""
    target = cases.select("event_id", "item_id").join(index, "item_id").select("event_id", "token")
    owned = index.select(F.col("item_id").alias("source_id"), "token")
    met = sources.join(owned, "source_id").join(target, ["event_id", "token"]).groupBy("event_id", "source_id", "recency").agg(F.count("*").alias("shared"))
    best = met.withColumn("r", F.row_number().over(Window.partitionBy("event_id").orderBy(F.desc("shared"), "recency"))).where("r = 1").select("event_id", F.col("source_id").alias("best_source"), "shared")
    with_text = sources.join(owned.select("source_id").distinct(), "source_id", "left_semi").select("event_id").distinct().withColumn("__text", F.lit(True))
    any_source = sources.groupBy("event_id").agg(F.count("*").alias("n_sources"))
    described = cases.select("event_id", "item_id").join(index.select("item_id").distinct(), "item_id", "left_semi").select("event_id", F.lit(True).alias("__target"))
    joined = cases.select("event_id", "item_id").join(any_source, "event_id", "left").join(with_text, "event_id", "left").join(described, "event_id", "left").join(best, "event_id", "left").join(target_ranks.select("event_id", "rank"), "event_id", "left")
    moved, shared = F.col("rank").isNotNull(), F.coalesce("shared", F.lit(0))
    absent = F.col("n_sources").isNull() | (F.col("__target").isNotNull() & F.col("__text").isNull())
    label = F.when(absent, "not_computed").when((shared > 0) & moved, "semantic_and_transition").when(shared > 0, "semantic_only").when(moved, "transition_only").otherwise("neither_semantic_nor_transition")
    return joined.select("event_id", "item_id", F.when(absent, F.lit(None)).otherwise(shared).alias("overlap_max"), label.alias("case_type"))


def random_key(seed: int, case: Column, item: Column) -> Column:
    """A key in [0, 1) from a hash of seed, case and item."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), case, item), 256), 1, 12), 16, 10).cast("double") / float(1 << 48)


def popular_unseen(cases: DataFrame, seen: DataFrame, counts: DataFrame) -> DataFrame:
    """(event_id, item_id) of the most popular item of counts(item_id, popularity) that is not among the case's seen(event_id, item_id).

    Its place in the order of popularity is the first that no seen item of the case takes.
    """
    placed = cut(numbered(counts.select("item_id", "popularity"), [F.desc("popularity"), "item_id"], "place").select("item_id", "place"))
    taken = seen.select("event_id", "item_id").distinct().join(placed, "item_id")
    run = taken.withColumn("r", F.row_number().over(Window.partitionBy("event_id").orderBy("place")) - 1).where("place = r").groupBy("event_id").agg(F.count("*").alias("place"))
    return cases.select("event_id").join(run, "event_id", "left").select("event_id", F.coalesce("place", F.lit(0)).cast("long").alias("place")).join(placed, "place").select("event_id", "item_id")


def hard_negatives(cases: DataFrame, items: DataFrame, seen: DataFrame, semantic: DataFrame, moves: DataFrame, counts: DataFrame, seed: int = 0) -> DataFrame:
    """For each case the semantic, transition, popularity and random hard negative among all items but its target and its seen ones.

    items(item_id), seen(event_id, item_id), semantic(event_id, item_id, overlap), moves(event_id, item_id, score, support),
    counts(item_id, popularity). The first three come from the rows that semantic and moves have; only the random
    one reads every pair of case and item, which are neither sent nor kept: each task holds the least key of a case.
    """
    taken = seen.select("event_id", "item_id").union(cases.select("event_id", "item_id")).distinct()
    rows = semantic.join(moves, ["event_id", "item_id"], "full_outer").join(items.select("item_id").distinct(), "item_id", "left_semi").join(taken, ["event_id", "item_id"], "left_anti").join(counts, "item_id", "left")
    rows = rows.select("event_id", "item_id", F.coalesce("overlap", F.lit(0)).alias("overlap"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("support", F.lit(0)).alias("support"), F.coalesce("popularity", F.lit(0)).alias("popularity"))
    least = lambda c, *o: F.min(F.when(c, F.struct(*o, F.col("item_id").alias("id"))))["id"]
    close = rows.groupBy("event_id").agg(
        least(F.col("overlap") > 0, (-F.col("overlap")).alias("a"), (F.col("support") > 0).alias("b"), F.col("score").alias("c"), (-F.col("popularity")).alias("d")).alias("semantic_negative"),
        least(F.col("score") > 0, (-F.col("score")).alias("a"), F.col("overlap").alias("b"), (-F.col("support")).alias("c")).alias("transition_negative"),
    )
    popular = popular_unseen(cases, taken, counts).withColumnRenamed("item_id", "popularity_negative")
    each = taken.groupBy("event_id").agg(F.collect_list("item_id").alias("taken")).crossJoin(items.select("item_id").distinct()).where(~F.array_contains("taken", F.col("item_id")))
    drawn = each.groupBy("event_id").agg(least(F.lit(True), random_key(seed, F.col("event_id"), F.col("item_id")).alias("a")).alias("random_negative"))
    return drawn.join(close, "event_id", "left").join(popular, "event_id", "left").select("event_id", "semantic_negative", "transition_negative", "popularity_negative", "random_negative")


def stress_rates(rows: DataFrame) -> DataFrame:
    """rows(target, negatives and their transition and semantic scores) -> coverage, trap and win rates over eligible cases."""
    return rows.agg(
        F.count("*").alias("cases"),
        F.avg(F.col("semantic_negative").isNotNull().cast("double")).alias("semantic_coverage"),
        F.avg(F.col("transition_negative").isNotNull().cast("double")).alias("transition_coverage"),
        F.avg(F.when(F.col("semantic_negative").isNotNull(), (F.col("negative_overlap") >= F.col("target_overlap")).cast("double"))).alias("semantic_trap_rate"),
        F.avg(F.when((F.col("target_score") > 0) & F.col("semantic_negative").isNotNull(), (F.col("target_score") > F.col("negative_score")).cast("double"))).alias("transition_win_rate"),
    )
