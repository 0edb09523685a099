"""Perturbed histories, and what they do to rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideloom.operators import rank, sequences

DAY = 86_400


def variants(histories: DataFrame, recent: int = 5, seed: int = 0) -> DataFrame:
    """histories(user_id, items) -> (user_id, variant, items), one row a variant."""
    items = F.col("items")
    made = {"original": items, "reversed": F.reverse(items), f"shuffled_seed_{seed}": sequences.hash_shuffled(items, F.col("user_id"), seed), f"recent_{recent}": sequences.tail(items, recent), f"remove_recent_{recent}": sequences.remove_recent(items, recent)}
    return histories.select("user_id", F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), c.alias("items")) for n, c in made.items()])).alias("v")).select("user_id", "v.*")


def swap_far_and_near(history: DataFrame, keys: Sequence[str] = ("case_id",), order: Sequence[str] = ("ts", "event_id"), near: int = 7 * DAY, far: int = 30 * DAY) -> DataFrame:
    """history(keys, case_ts, ts, event_id, item_id) with the times of the n-th event of the last week and the n-th of over 30 days ago exchanged.

    Each event looks up its partner by class and ordinal, so a history is partitioned and never gathered.
    """
    age = F.col("case_ts") - F.col("ts")
    side = F.when(age <= near, "near").when(age > far, "far")
    placed = history.withColumn("__side", side).withColumn("__n", F.row_number().over(Window.partitionBy(*keys, "__side").orderBy(*order)))
    other = placed.where("__side is not null").select(*keys, F.when(F.col("__side") == "near", "far").otherwise("near").alias("__side"), "__n", F.col("ts").alias("__ts"))
    met = placed.join(other, [*keys, "__side", "__n"], "left")
    return met.withColumn("swapped_ts", F.coalesce("__ts", "ts")).drop("__side", "__n", "__ts")


def without_times(history: DataFrame) -> DataFrame:
    return history.withColumn("ts", F.lit(None).cast("long"))


def random_times(history: DataFrame, seed: int, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """Times of each history dealt anew in hash order; the multiset stays, and so none lies after its case."""
    by_time = F.row_number().over(Window.partitionBy(*keys).orderBy("ts", "event_id"))
    by_hash = F.row_number().over(Window.partitionBy(*keys).orderBy(F.sha2(F.concat_ws("|", F.lit(seed), *keys, "event_id"), 256)))
    times = history.select(*keys, "ts", by_time.alias("__n"))
    return history.drop("ts").withColumn("__n", by_hash).join(times, [*keys, "__n"]).drop("__n")


def retrieve(variants_of: DataFrame, edges: DataFrame, seen: DataFrame, last: int = 5) -> DataFrame:
    """Summed transition counts from the last items of each variant to items unseen by the user: (user_id, variant, item_id, score)."""
    recent = variants_of.select("user_id", "variant", F.explode(sequences.tail(F.col("items"), last)).alias("source_id"))
    scored = recent.join(edges.select("source_id", "target_id", "count"), "source_id").groupBy("user_id", "variant", F.col("target_id").alias("item_id")).agg(F.sum("count").cast("double").alias("score"))
    return scored.join(seen, ["user_id", "item_id"], "left_anti")


def rank_changes(ranks: DataFrame, keys: Sequence[str], k: int = 10) -> DataFrame:
    """ranks(keys, variant, rank) -> each variant's rank change and hit change against the original."""
    base = ranks.where("variant = 'original'").select(*keys, F.col("rank").alias("base_rank"))
    hit = lambda c: F.coalesce((F.col(c) <= k).cast("int"), F.lit(0))
    return ranks.where("variant <> 'original'").join(base, list(keys)).select(*keys, "variant", "rank", "base_rank", (F.col("rank") - F.col("base_rank")).alias("rank_delta"), (hit("rank") - hit("base_rank")).alias("hit_delta"))


def window_rank(histories: DataFrame, candidates: DataFrame, edges: DataFrame, last: int = 5) -> DataFrame:
    """Candidates by the summed weights, either way round, of window edges with the last items; a self-loop counts twice."""
    both = edges.select("source_id", "target_id", "weight").union(edges.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "weight"))
    weights = both.groupBy("source_id", F.col("target_id").alias("item_id")).agg(F.sum("weight").alias("weight"))
    recent = histories.select("user_id", F.explode(sequences.tail(F.col("items"), last)).alias("source_id"))
    scored = recent.join(candidates, "user_id").join(weights, ["source_id", "item_id"], "left")
    return scored.groupBy("user_id", "item_id").agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("score"))


def window_rank_top_k(histories: DataFrame, items: DataFrame, edges: DataFrame, k: int, last: int = 5) -> DataFrame:
    """The best k of all items by window_rank(): no other item can be among them than those that an edge reaches and the k least ids, which lead the items without a weight."""
    both = edges.select("source_id", F.col("target_id").alias("item_id")).union(edges.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("item_id"))).distinct()
    users = histories.select("user_id")
    reached = histories.select("user_id", F.explode(sequences.tail(F.col("items"), last)).alias("source_id")).join(both, "source_id").select("user_id", "item_id").join(items.select("item_id").distinct(), "item_id", "left_semi").select("user_id", "item_id")
    first = items.select("item_id").distinct().orderBy("item_id").limit(k)
    candidates = reached.union(users.crossJoin(F.broadcast(first))).distinct()
    return rank.top_k(window_rank(histories, candidates, edges, last), ["user_id"], k)
