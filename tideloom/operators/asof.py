"""As-of statistics of evaluation cases: only training events before a case count."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideloom.functions.cuts import cut
from tideloom.functions.deal import together
from tideloom.operators.asof_edges import edges_before
from tideloom.operators.graph import GAP_BUCKETS, strict_transitions
from tideloom.operators.prep import numbered
from tideloom.operators.sequences import gap_bucket


def counts_before(asked: DataFrame, rows: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """asked(event_id, keys, ts) with the number of rows(keys, ts) of the same keys at earlier times.

    One sorted pass over the union in place of a range join; rows of one time are added up first.
    """
    steps = rows.groupBy(*keys, "ts").agg(F.count("*").alias("n")).select(*keys, "ts", "n", F.lit(None).cast("long").alias("event_id"))
    w = Window.partitionBy(*keys).orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    both = steps.union(asked.select(*keys, "ts", F.lit(0).cast("long").alias("n"), "event_id"))
    return both.select(*keys, "event_id", F.coalesce(F.sum("n").over(w), F.lit(0)).alias(name)).where("event_id is not null")


def popularity(cases: DataFrame, train: DataFrame) -> DataFrame:
    """cases(event_id, item_id, ts) with the target's training count strictly before the case."""
    return cases.join(counts_before(cases, train, ["item_id"], "popularity").drop("item_id"), "event_id")


_RECENT = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("source_id", T.LongType()), T.StructField("recency", T.IntegerType())])


def sources_of(cases: DataFrame, events: DataFrame, most: int) -> DataFrame:
    """The last distinct items of each case's user strictly before it, newest first: (event_id, source_id, recency).

    One pass over cases and events in the order of each user's times, which holds the user's last `most`
    distinct items: no case meets a user's history, however many cases a user has. Rows without a user or time meet nothing.
    """
    past = events.select("user_id", "ts", F.lit(1).alias("kind"), F.col("event_id").cast("long").alias("event_id"), F.col("item_id").cast("long").alias("item_id"))
    asked = cases.select("user_id", "ts", F.lit(0).alias("kind"), F.col("event_id").cast("long").alias("event_id"), F.lit(None).cast("long").alias("item_id"))
    whole = past.union(asked).where("user_id is not null and ts is not null")
    ordered = together(whole, "user_id").sortWithinPartitions("user_id", "ts", "kind", "event_id")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, held = None, {}
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for who, kind, event, item in zip(*[batch.column(c).to_pylist() for c in ("user_id", "kind", "event_id", "item_id")], strict=True):
                if who != user:
                    user, held = who, {}
                if kind:
                    held.pop(item, None)
                    held[item] = None  # dicts keep the order of insertion
                    if len(held) > most:
                        del held[next(iter(held))]
                else:
                    out[0].extend([event] * len(held))
                    out[1].extend(reversed(held))
                    out[2].extend(range(1, len(held) + 1))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32())], names=["event_id", "source_id", "recency"])

    return ordered.mapInArrow(walk, _RECENT)


def seen_before(cases: DataFrame, events: DataFrame) -> DataFrame:
    """(event_id, item_id): every item of the case's user strictly before it. An item's first time decides, one row a user and item."""
    first = events.groupBy("user_id", "item_id").agg(F.min("ts").alias("__first"))
    return cases.select("event_id", "user_id", "ts").join(first, "user_id").where("__first < ts").select("event_id", "item_id")


def retrieve(cases: DataFrame, labelled: DataFrame, source_items: int = 20, per_source: int = 50) -> DataFrame:
    """As-of candidates of each case: (event_id, candidate_id, score, rank), seen items left out unless the target.

    A source's targets score their share of the source's transitions observed before the case; the best
    `per_source` of each source merge by maximum; ties by id. A case meets each target of its sources once, whatever
    the number of transitions; how many were before the case comes from one sorted pass by (source, target). The
    labelled events and the sources are cut: they feed several branches.
    """
    labelled = cut(labelled.select("event_id", "user_id", "item_id", "ts", "split"))
    moves = cut(strict_transitions(labelled.where("split = 'train'")).select("source_id", "target_id", F.col("target_ts").alias("ts")))
    mine = labelled.where("split <> 'test'").select("user_id", "item_id", "ts", "event_id")
    timed = cut(sources_of(cases, mine, source_items).join(cases.select("event_id", "ts"), "event_id"))
    first = moves.groupBy("source_id", "target_id").agg(F.min("ts").alias("__first"))
    met = timed.join(first, "source_id").where("__first < ts").select("event_id", "source_id", "target_id", "ts")
    found = counts_before(met, moves, ["source_id", "target_id"], "support")
    share = F.col("support") / F.sum("support").over(Window.partitionBy("event_id", "source_id"))
    ranked = found.withColumn("score", share)
    w = Window.partitionBy("event_id", "source_id").orderBy(F.desc("score"), "target_id")
    best = ranked.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= per_source)
    merged = best.groupBy("event_id", F.col("target_id").alias("candidate_id")).agg(F.max("score").alias("score"))
    seen = seen_before(cases, mine).join(cases.select("event_id", F.col("item_id").alias("target")), "event_id").where("item_id <> target").select("event_id", F.col("item_id").alias("candidate_id"))
    left = merged.join(seen, ["event_id", "candidate_id"], "left_anti")
    order = Window.partitionBy("event_id").orderBy(F.desc("score"), "candidate_id")
    return left.withColumn("rank", F.row_number().over(order))


def all_before(asked: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """asked(event_id, ts) with the number of all rows(ts) at earlier times.

    A count without a key has no partition to sort in, so it is a prefix sum of two levels: rows are dealt by
    ranges of time, each range has one total, and a row adds the totals of the ranges before it to the count
    within its own.
    """
    steps = rows.groupBy("ts").agg(F.count("*").alias("n")).select("ts", "n", F.lit(None).cast("long").alias("event_id"))
    both = cut(steps.union(asked.select("ts", F.lit(0).cast("long").alias("n"), "event_id")).repartitionByRange("ts").withColumn("range", F.spark_partition_id()))
    totals = both.groupBy("range").agg(F.sum("n").alias("total"))
    before = totals.select("range", F.coalesce(F.sum("total").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # one row a partition
    w = Window.partitionBy("range").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    placed = both.select("event_id", "range", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("within")).where("event_id is not null")
    return placed.join(F.broadcast(before), "range").select("event_id", (F.col("within") + F.col("before")).alias(name))


SCORES = ("support", "transition_probability", "lift", "pmi")


def scored_edges(cases: DataFrame, labelled: DataFrame, source_items: int = 20, best: tuple[str, int] | None = None, asks_a_slice: int = 10_000, edges_a_task: int = 500_000) -> DataFrame:
    """What was known of each edge of a case's sources strictly before the case.

    (event_id, source_id, target_id, support, transition_probability, lift, pmi, last_ts, gap_*). lift is the edge's
    probability over the target's share of all transitions so far; pmi is its logarithm. With best = (score, number), only
    the best edges of each source, which are all that merged_candidates() takes. See edges_before() for what a task holds.
    """
    strict = strict_transitions(labelled.where("split = 'train'").select("event_id", "user_id", "item_id", "ts"))
    bucket = F.array_position(F.array(*[F.lit(b) for b in GAP_BUCKETS]), gap_bucket(F.col("target_ts") - F.col("source_ts"))) - 1
    moves = cut(strict.select("source_id", "target_id", F.col("target_ts").alias("ts"), bucket.cast("long").alias("bucket")))
    timed = cut(sources_of(cases, labelled.where("split <> 'test'"), source_items).join(cases.select("event_id", "ts"), "event_id"))
    found = edges_before(timed, moves, best, asks_a_slice, edges_a_task)
    return found.select("event_id", "source_id", "target_id", "support", "transition_probability", "lift", F.log("lift").alias("pmi"), "last_ts", *[f"gap_{b}" for b in GAP_BUCKETS])


def merged_candidates(edges: DataFrame, score: str = "transition_probability", merge: str = "max", per_source: int = 50) -> DataFrame:
    """scored_edges(...) -> (event_id, candidate_id, score, support, last_ts, sources): the best edges of each source, put together.

    score is one of SCORES, or a gap bucket, which then scores by its count. Only scores above zero count; ties go by
    support, the later last time, then id. merge: max or sum.
    """
    if merge not in ("max", "sum"):
        raise ValueError("merge must be max or sum")
    column = f"gap_{score}" if score in GAP_BUCKETS else score
    if column not in edges.columns or score not in (*SCORES, *GAP_BUCKETS):
        raise ValueError(f"no such score: {score}")
    w = Window.partitionBy("event_id", "source_id").orderBy(F.desc("__s"), F.desc("support"), F.desc("last_ts"), "target_id")
    best = edges.withColumn("__s", F.col(column).cast("double")).where("__s > 0").withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= per_source)
    return best.groupBy("event_id", F.col("target_id").alias("candidate_id")).agg(getattr(F, merge)("__s").alias("score"), F.sum("support").alias("support"), F.max("last_ts").alias("last_ts"), F.count("*").alias("sources"))


def target_ranks(cases: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Each case's rank of its target, null where it was not retrieved."""
    hits = retrieved.select("event_id", F.col("candidate_id").alias("item_id"), "rank")
    return cases.select("event_id", "user_id", "item_id", "ts").join(hits, ["event_id", "item_id"], "left")


def cooccurrence(train: DataFrame, window: int = 200) -> DataFrame:
    """Symmetric counts of item pairs among a user's first sights, within the last `window` distinct items.

    A banded join: an item's place falls in a band of `window` places and looks into the next band too, so a
    long history costs its length times the window and not its square.
    """
    first = train.groupBy("user_id", "item_id").agg(F.min(F.struct("ts", "event_id")).alias("at"))
    placed = first.withColumn("p", F.row_number().over(Window.partitionBy("user_id").orderBy("at"))).withColumn("band", F.expr(f"p div {window}"))
    a = placed.select("user_id", F.col("item_id").alias("a"), F.col("p").alias("pa"), F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"))
    b = placed.select("user_id", F.col("item_id").alias("b"), F.col("p").alias("pb"), "band")
    pairs = a.join(b, ["user_id", "band"]).where((F.col("pb") > F.col("pa")) & (F.col("pb") - F.col("pa") <= window)).groupBy("a", "b").agg(F.count("*").alias("n"))
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    return both.groupBy("a", "b").agg(F.sum("n").alias("count")).select(F.col("a").alias("item_id"), F.col("b").alias("neighbor_id"), "count")


def item_knn(cases: DataFrame, history: DataFrame, pairs: DataFrame, neighbors: int = 50) -> DataFrame:
    """Scores of candidates: over the case's history items, the counts of each one's best neighbours."""
    w = Window.partitionBy("item_id").orderBy(F.desc("count"), "neighbor_id")
    best = pairs.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= neighbors)
    return seen_before(cases, history).join(best, "item_id").groupBy("event_id", F.col("neighbor_id").alias("candidate_id")).agg(F.sum("count").alias("score"))


def full_rank(cases: DataFrame, scores: DataFrame, items: DataFrame, seen: DataFrame) -> DataFrame:
    """The target's rank among all unseen items: score descending, id ascending, no score being 0.

    The zero tail is counted and not listed: a target without score stands behind the scored items and the
    unscored, unseen items of smaller id. Nothing of size cases x items is made.
    """
    target = cases.select("event_id", "item_id").join(numbered(items.select("item_id").distinct(), ["item_id"], "__below"), "item_id")
    open_seen = seen.join(cases.select("event_id", F.col("item_id").alias("target")), "event_id").where("item_id <> target")
    live = scores.where("score > 0").withColumnRenamed("candidate_id", "item_id").join(open_seen.select("event_id", "item_id"), ["event_id", "item_id"], "left_anti")
    own = target.join(live, ["event_id", "item_id"], "left").select("event_id", F.col("item_id").alias("target"), "__below", F.coalesce("score", F.lit(0.0)).alias("own"))
    above = own.join(live, "event_id", "left").groupBy("event_id").agg(F.count_if((F.col("score") > F.col("own")) | ((F.col("score") == F.col("own")) & (F.col("item_id") < F.col("target")))).alias("ahead"), F.count_if(F.col("item_id") < F.col("target")).alias("scored_below"))
    hidden = own.select("event_id", "target").join(open_seen.select("event_id", "item_id").distinct(), "event_id", "left").groupBy("event_id").agg(F.count_if(F.col("item_id") < F.col("target")).alias("seen_below"))
    rank = F.when(F.col("own") > 0, F.col("ahead") + 1).otherwise(F.col("ahead") + F.col("__below") - F.col("scored_below") - F.col("seen_below") + 1)
    return own.join(above, "event_id").join(hidden, "event_id").select("event_id", F.col("target").alias("item_id"), rank.cast("long").alias("rank"))


def popularity_rank(cases: DataFrame, counts: DataFrame, items: DataFrame, seen: DataFrame) -> DataFrame:
    """The target's rank among unseen items by one global score: its place in the catalogue less the seen items before it.

    counts(item_id, score). One ordering of the catalogue serves all cases; nothing of size cases x items is made.
    """
    scored = items.select("item_id").distinct().join(counts, "item_id", "left").select("item_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    placed = numbered(scored, [F.desc("score"), "item_id"], "__place").select("item_id", "__place")
    target = cases.select("event_id", "item_id").join(placed, "item_id").select("event_id", F.col("item_id").alias("target"), F.col("__place").alias("__own"))
    before = target.join(seen.select("event_id", "item_id").distinct().join(placed, "item_id"), "event_id", "left")
    ahead = F.count_if((F.col("item_id") != F.col("target")) & (F.col("__place") < F.col("__own")))
    return before.groupBy("event_id", "target", "__own").agg(ahead.alias("__ahead")).select("event_id", F.col("target").alias("item_id"), (F.col("__own") - F.col("__ahead") + 1).cast("long").alias("rank"))
