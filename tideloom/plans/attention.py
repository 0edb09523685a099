"""Queries: the self-attention model of sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideloom.functions.cuts import cut
from tideloom.operators import attention, prep, sequences
from tideloom.plans.base import rounded, split_events, test_cases, train_events
from tideloom.plans.registry import register
from tideloom.sources.tables import event_interactions

_LENGTH, _SIZE = 10, 8


def _fitted(spark, folder, steps):
    items = event_interactions(spark, folder).select("item_id").distinct()
    examples = sequences.training_examples(train_events(spark, folder), items, _LENGTH, 2)
    places = cut(prep.numbered(items, ["item_id"], "place").select("item_id", (F.col("place") + 1).alias("place")))
    first = attention.item_table(places, _SIZE)
    return places, attention.fit(examples, first, attention.drawn_weights(_SIZE, _LENGTH), steps)


@register("attention_losses")
def _(spark, folder):
    """Mean loss before each of four gradient steps over all training examples."""
    _, (_, _, losses) = _fitted(spark, folder, 4)
    return spark.createDataFrame([(i, round(x, 6)) for i, x in enumerate(losses)], "step int, loss double")


@register("attention_topk")
def _(spark, folder):
    """The five best items of each test case, from the user's last ten events before it, after three steps."""
    places, (items, weights, _) = _fitted(spark, folder, 3)
    cases = sequences.examples(split_events(spark, folder), _LENGTH).where("split = 'test'").select("event_id", F.posexplode("history").alias("at", "item_id")).join(places, "item_id")
    padded = cases.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("at", "place"))).alias("h")).select("event_id", sequences.left_pad(F.col("h.place"), _LENGTH).alias("input"))
    found = attention.top_k(padded, items, weights, 5).join(places, "place")
    return rounded(test_cases(spark, folder).select("event_id").join(found, "event_id").select("event_id", "item_id", "score", "rank"))
