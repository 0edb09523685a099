"""Item graphs from interaction sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideloom.functions.cuts import cut
from tideloom.operators.sequences import gap_bucket, time_bucket

GAP_BUCKETS = ("same_session", "within_1d", "within_1w", "within_1m", "long_gap")


def transitions(events: DataFrame, order: Sequence[str] = ("ts", "event_id"), include_ties: bool = False) -> DataFrame:
    """Consecutive pairs of each user: (user_id, source_id, target_id, source_ts, target_ts, gap).

    A pair of equal times is left out unless include_ties; the later of the two still leads on.
    """
    w = Window.partitionBy("user_id").orderBy(*order)
    pairs = events.select("user_id", F.lag("item_id").over(w).alias("source_id"), F.col("item_id").alias("target_id"), F.lag("ts").over(w).alias("source_ts"), F.col("ts").alias("target_ts")).where("source_ts is not null")
    pairs = pairs.withColumn("gap", F.col("target_ts") - F.col("source_ts"))
    return pairs if include_ties else pairs.where("gap > 0")


def strict_transitions(events: DataFrame, order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """The stricter tie rule of as-of replay: no pair leaves a group of tied events."""
    w = Window.partitionBy("user_id").orderBy(*order)
    size = F.count("*").over(Window.partitionBy("user_id", "ts"))
    sized = events.withColumn("__n", size)
    pairs = sized.select("user_id", F.lag("item_id").over(w).alias("source_id"), F.col("item_id").alias("target_id"), F.lag("ts").over(w).alias("source_ts"), F.col("ts").alias("target_ts"), F.lag("__n").over(w).alias("__before"))
    return pairs.where("source_ts < target_ts and __before = 1").drop("__before").withColumn("gap", F.col("target_ts") - F.col("source_ts"))


def tie_skips(events: DataFrame) -> DataFrame:
    """Counters of the strict rule: tied groups, pairs within them, and groups that a later event follows."""
    last = F.max("ts").over(Window.partitionBy("user_id"))
    groups = events.withColumn("__last", last).groupBy("user_id", "ts").agg(F.count("*").alias("n"), F.first("__last").alias("last")).where("n > 1")
    return groups.agg(F.count("*").alias("tied_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("tied_pairs"), F.count_if(F.col("last") > F.col("ts")).alias("bridges"))


def tdig_edges(pairs: DataFrame) -> DataFrame:
    """Edge statistics: support, P(target|source), lift, PMI, asymmetry, times, mean gap and gap histogram.

    Totals by source, target and reverse edge are aggregates of the edge table and not of the pairs. The edge
    table is cut, so the pairs are made and shuffled once for all four of its uses.
    """
    buckets = [F.count_if(gap_bucket(F.col("gap")) == b).alias(f"gap_{b}") for b in GAP_BUCKETS]
    edges = pairs.groupBy("source_id", "target_id").agg(F.count("*").alias("support"), F.min("target_ts").alias("first_ts"), F.max("target_ts").alias("last_ts"), F.avg("target_ts").alias("mean_ts"), F.avg("gap").alias("mean_gap"), *buckets)
    edges = cut(edges)
    out = edges.groupBy("source_id").agg(F.sum("support").alias("__out"))
    into = edges.groupBy("target_id").agg(F.sum("support").alias("__in"))
    total = edges.agg(F.sum("support").alias("__all"))
    back = edges.select(F.col("source_id").alias("target_id"), F.col("target_id").alias("source_id"), F.col("support").alias("__back"))
    joined = edges.join(out, "source_id").join(into, "target_id").join(back, ["source_id", "target_id"], "left").crossJoin(F.broadcast(total))
    reverse = F.coalesce("__back", F.lit(0))
    lift = F.col("support") * F.col("__all") / (F.col("__out") * F.col("__in"))
    return joined.select("source_id", "target_id", "support", (F.col("support") / F.col("__out")).alias("transition_probability"), lift.alias("lift"), F.ln(lift).alias("pmi"), ((F.col("support") - reverse) / (F.col("support") + reverse)).alias("direction_asymmetry"), "first_ts", "last_ts", "mean_ts", "mean_gap", *[f"gap_{b}" for b in GAP_BUCKETS])


def top_targets(edges: DataFrame, k: int, score: str = "transition_probability") -> DataFrame:
    """The k best targets of every source; ties by support, recency and id. The rank filter stands on the window, so Spark cuts groups before the shuffle."""
    w = Window.partitionBy("source_id").orderBy(F.desc(score), F.desc("support"), F.desc("last_ts"), "target_id")
    return edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def transition_edges(events: DataFrame, order: Sequence[str] = ("ts", "item_id")) -> DataFrame:
    """All consecutive pairs, self-loops and null gaps too: count, users, mean and median gap, bucket histogram."""
    w = Window.partitionBy("user_id").orderBy(*order)
    pairs = events.select("user_id", F.lag("item_id").over(w).alias("source_id"), F.col("item_id").alias("target_id"), (F.col("ts") - F.lag("ts").over(w)).alias("gap"), F.row_number().over(w).alias("__r")).where("__r > 1")
    counted = [F.count_if(time_bucket(F.col("gap")) == b).alias(f"n_{b}") for b in ("same_session", "same_day", "same_week", "same_month", "old", "unknown")]
    return pairs.groupBy("source_id", "target_id").agg(F.count("*").alias("count"), F.count_distinct("user_id").alias("user_count"), F.avg("gap").alias("mean_gap"), F.median("gap").alias("median_gap"), *counted)


def window_edges(events: DataFrame, seconds: int, directed: bool = True, half_life: float | None = None, order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """Pairs of one user's events within `seconds`: count, users and weight (count, or a sum of 0.5^(gap / half_life)).

    A banded join: each event goes to its own stretch of time and looks into the next one too, so pairs
    are formed within stretches and not over a user's whole history. Self-pairs and zero gaps are kept.
    """
    placed = events.where("ts is not null").select("user_id", "item_id", "ts", F.struct(*order).alias("o"), F.floor(F.col("ts") / seconds).cast("long").alias("b"))
    a = placed.select("user_id", F.col("item_id").alias("source_id"), F.col("ts").alias("source_ts"), F.col("o").alias("so"), F.explode(F.array(F.col("b"), F.col("b") + 1)).alias("b"))
    z = placed.select("user_id", F.col("item_id").alias("target_id"), F.col("ts").alias("target_ts"), F.col("o").alias("to"), "b")
    pairs = a.join(z, ["user_id", "b"]).where((F.col("so") < F.col("to")) & (F.col("target_ts") - F.col("source_ts") <= seconds))
    if not directed:
        x, y = F.col("source_id").cast("string"), F.col("target_id").cast("string")
        swap = x > y
        pairs = pairs.select("user_id", F.when(swap, F.col("target_id")).otherwise(F.col("source_id")).alias("source_id"), F.when(swap, F.col("source_id")).otherwise(F.col("target_id")).alias("target_id"), "source_ts", "target_ts")
    gap = F.col("target_ts") - F.col("source_ts")
    weight = F.count("*").cast("double") if half_life is None else F.sum(F.pow(F.lit(0.5), gap / half_life))
    return pairs.groupBy("source_id", "target_id").agg(F.count("*").alias("count"), F.count_distinct("user_id").alias("user_count"), F.avg(gap).alias("mean_gap"), weight.alias("weight"))


def window_sweep(events: DataFrame, windows: dict[str, int], order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """Edges and weights of several window lengths."""
    parts = [window_edges(events, s, order=order).agg(F.count("*").alias("edges"), F.sum("count").alias("pairs"), F.sum("user_count").alias("users")).withColumn("window", F.lit(n)) for n, s in windows.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def decayed(edges: DataFrame, half_life: float) -> DataFrame:
    """Transition edges weighed by their mean gap."""
    return edges.withColumn("weight", F.when(F.col("mean_gap").isNull(), F.col("count").cast("double")).otherwise(F.col("count") * F.pow(F.lit(0.5), F.col("mean_gap") / half_life)))


def edge_summary(edges: DataFrame, weight: str, users: str, buckets: Sequence[str] = ()) -> DataFrame:
    """Edges, summed users and weight; with buckets, the most frequent one (ties by name)."""
    sums = [F.sum(b).alias(b) for b in buckets]
    row = edges.agg(F.count("*").alias("edges"), F.coalesce(F.sum(users), F.lit(0)).alias("users"), F.coalesce(F.sum(weight), F.lit(0)).alias("weight"), *sums)
    if not buckets:
        return row
    best = F.array_sort(F.array(*[F.struct((-F.col(b)).alias("n"), F.lit(b.removeprefix("n_").removeprefix("gap_")).alias("b")) for b in buckets]))[0]["b"]
    return row.select("edges", "users", "weight", best.alias("dominant_bucket"))


def coverage(edges: DataFrame, items: DataFrame) -> DataFrame:
    """Share of the catalogue that an edge touches, and mean support."""
    touched = edges.select(F.col("source_id").alias("item_id")).union(edges.select(F.col("target_id").alias("item_id"))).distinct()
    n = items.select("item_id").distinct().agg(F.count("*").alias("items"))
    hit = items.select("item_id").distinct().join(touched, "item_id", "left_semi").agg(F.count("*").alias("touched"))
    mean = edges.agg(F.avg("support").alias("mean_support"))
    return n.crossJoin(hit).crossJoin(mean).select("items", "touched", (F.col("touched") / F.col("items")).alias("coverage"), "mean_support")
