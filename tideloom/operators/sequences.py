"""Gaps, histories and transforms of user sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideloom.operators.prep import numbered

HOUR, DAY = 3600, 86_400


def gap_bucket(gap: Column) -> Column:
    """Bounds of 30 minutes, a day, a week and 30 days, each inclusive."""
    return F.when(gap <= HOUR // 2, "same_session").when(gap <= DAY, "within_1d").when(gap <= 7 * DAY, "within_1w").when(gap <= 30 * DAY, "within_1m").otherwise("long_gap")


def time_bucket(gap: Column) -> Column:
    """Bounds of an hour, a day, a week and 30 days; unknown for null."""
    return F.when(gap.isNull(), "unknown").when(gap <= HOUR, "same_session").when(gap <= DAY, "same_day").when(gap <= 7 * DAY, "same_week").when(gap <= 30 * DAY, "same_month").otherwise("old")


def gaps(interactions: DataFrame, order: Sequence[str] = ("ts", "item_id")) -> DataFrame:
    """Each event's place, gap to the one before and its bucket."""
    w = Window.partitionBy("user_id").orderBy(*order)
    gap = F.col("ts") - F.lag("ts").over(w)
    return interactions.select("user_id", "item_id", "ts", (F.row_number().over(w) - 1).alias("place"), gap.alias("gap")).withColumn("bucket", time_bucket(F.col("gap")))


def histories(interactions: DataFrame, order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """Item arrays by user, in order."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, "item_id")))
    return interactions.groupBy("user_id").agg(ordered.alias("__h")).select("user_id", F.col("__h.item_id").alias("items"), F.col("__h.ts").alias("times"))


def tail(array: Column, k: int) -> Column:
    """The last k elements; all for 0."""
    return array if k == 0 else F.slice(array, F.greatest(F.size(array) - k + 1, F.lit(1)), k)


def recency_blocks(items: Column) -> Column:
    """Thirds of a history by whole division: long, mid and short term."""
    n = F.size(items)
    a, b = F.floor(n / 3).cast("int"), F.floor(2 * n / 3).cast("int")
    return F.struct(F.slice(items, 1, a).alias("long_term"), F.slice(items, a + 1, b - a).alias("mid_term"), F.slice(items, b + 1, n - b).alias("short_term"))


def recent_unique(items: Column, k: int) -> Column:
    """Distinct items, most recent first, k at most (0: all)."""
    found = F.array_distinct(F.reverse(items))
    return found if k == 0 else F.slice(found, 1, k)


def left_pad(items: Column, length: int) -> Column:
    """The last `length` items behind as many zeros as are missing."""
    cut = tail(items, length)
    return F.concat(F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(length) - F.size(cut), F.lit(0))), cut)


def remove_recent(items: Column, k: int) -> Column:
    return F.slice(items, 1, F.greatest(F.size(items) - k, F.lit(0)))


def hash_shuffled(items: Column, key: Column, seed: int) -> Column:
    """A fixed permutation: by a hash of seed, key and place."""
    tagged = F.transform(items, lambda x, i: F.struct(F.sha2(F.concat_ws("|", F.lit(seed), key, i, x), 256).alias("h"), x.alias("x")))
    return F.transform(F.array_sort(tagged), lambda s: s["x"])


def popularity_sorted(interactions: DataFrame, counts: DataFrame, order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """Histories ordered by descending popularity, then item."""
    joined = interactions.join(counts.withColumnRenamed("count", "__c"), "item_id", "left")
    ordered = F.array_sort(F.collect_list(F.struct((-F.coalesce("__c", F.lit(0))).alias("c"), "item_id", *order)))
    return joined.groupBy("user_id").agg(ordered.alias("__h")).select("user_id", F.col("__h.item_id").alias("items"))


def examples(labelled: DataFrame, max_history: int = 50, order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """Evaluation cases with their histories: val after train rows, test after train and val rows."""
    past = labelled.where("split <> 'test'").select("user_id", F.struct(*order, "item_id", "split").alias("e"))
    grouped = past.groupBy("user_id").agg(F.array_sort(F.collect_list("e")).alias("h"))
    cases = labelled.where("split in ('val', 'test')").join(grouped, "user_id", "left")
    kept = F.filter("h", lambda e: (F.col("split") == "test") | (e["split"] == "train"))
    return cases.select("event_id", "user_id", "item_id", "ts", "split", tail(F.transform(kept, lambda e: e["item_id"]), max_history).alias("history"))


def prefixes(labelled: DataFrame, max_history: int = 50, order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """Training rows with the items before them."""
    w = Window.partitionBy("user_id").orderBy(*order)
    frame = w.rowsBetween(-max_history if max_history else Window.unboundedPreceding, -1)
    return labelled.where("split = 'train'").select("event_id", "user_id", "item_id", "ts", F.collect_list("item_id").over(frame).alias("history")).where(F.size("history") > 0)


def training_examples(train: DataFrame, items: DataFrame, max_history: int = 50, negatives: int = 1, seed: int = 0, order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """Next-item examples: (event_id, input, positive, negatives), items as 1 and up in the order of their ids, 0 for padding.

    A row's input is the user's rows before it. Negatives are drawn, with replacement, from the items that the user
    never has: draw r among these is item number r plus the user's own items up to there, so no user meets the
    catalogue. A user who has every item gets none.
    """
    placed = numbered(items.select("item_id").distinct(), ["item_id"], "place").select("item_id", "place")
    count = placed.count()
    rows = train.select("event_id", "user_id", "item_id", *[c for c in order if c not in ("event_id", "user_id", "item_id")]).join(placed, "item_id")
    own = rows.groupBy("user_id").agg(F.array_sort(F.collect_set("place")).alias("own"))
    past = F.collect_list(F.col("place") + 1).over(Window.partitionBy("user_id").orderBy(*order).rowsBetween(-max_history, -1))
    made = rows.withColumn("past", past).where(F.size("past") > 0).join(own, "user_id").withColumn("free", F.lit(count) - F.size("own"))
    draw = lambda j: F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), "event_id", j), 256), 1, 12), 16, 10).cast("long"), F.col("free"))
    number = lambda r: r + F.size(F.filter("own", lambda x, i: x - i <= r)) + 1
    drawn = F.transform(F.sequence(F.lit(0), F.lit(negatives - 1)), lambda j: number(draw(j)))
    return made.select("event_id", left_pad(F.col("past"), max_history).alias("input"), (F.col("place") + 1).alias("positive"), F.when(F.col("free") > 0, drawn).otherwise(F.array().cast("array<bigint>")).alias("negatives"))


def text_vector(columns: Sequence[str]) -> Column:
    """A fixed vector of an item's texts: how many different words they have, and those words' characters."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.concat_ws(" ", *columns)), "\\s+"), lambda w: w != ""))
    return F.array(F.size(words).cast("double"), F.aggregate(words, F.lit(0), lambda n, w: n + F.length(w)).cast("double"))


def memory_vector(count: Column, ts: Column, dimension: int = 4) -> Column:
    """A fixed vector of how often a user or item was seen and the time asked about."""
    values = [count.cast("double"), F.coalesce(ts.cast("double"), F.lit(0.0))]
    values += [(count + n) / float(max(1, dimension)) for n in range(2, dimension)]
    return F.array(*values[:dimension])
