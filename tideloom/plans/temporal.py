"""Queries: node memories of the event graph."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tideloom.operators import asof, temporal
from tideloom.plans import sql
from tideloom.plans.base import rounded, split_events, test_cases, train_events
from tideloom.plans.registry import register

_SIZE = 8
_WEIGHT, _BIAS = [(i + 1) / 100 for i in range(_SIZE)], [(-1) ** i / 10 for i in range(_SIZE)]


def _asked(spark, folder):
    """Each test case with its target and its user's last 20 items."""
    cases = test_cases(spark, folder).select("event_id", "user_id", "item_id", "ts")
    recent = asof.sources_of(cases, split_events(spark, folder).where("split <> 'test'"), 20)
    return cases.unionByName(recent.join(cases.select("event_id", "user_id", "ts"), "event_id").select("event_id", "user_id", F.col("source_id").alias("item_id"), "ts")).distinct()


_FIXED = """e AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS place, embedding[1:8]::DOUBLE[] AS vec FROM embeddings),
m AS (SELECT count(*) AS m FROM embeddings),
asked AS (SELECT event_id, user_id, item_id, ts FROM cases UNION SELECT s.event_id, c.user_id, s.source_id, c.ts FROM sources s JOIN cases c USING (event_id)),
ver AS (
  SELECT 0 AS kind, user_id AS id, ts, event_id, (event_id % m) AS place FROM loo, m WHERE split = 'train'
  UNION ALL SELECT 1, item_id, ts, event_id, ((event_id + 1) % m) FROM loo, m WHERE split = 'train'),
own AS (SELECT a.event_id, a.item_id, arg_max(v.place, (v.ts, v.event_id)) AS place FROM asked a JOIN ver v ON v.kind = 0 AND v.id = a.user_id AND v.ts < a.ts GROUP BY ALL),
touched AS (SELECT a.event_id, a.item_id, arg_max(v.place, (v.ts, v.event_id)) AS place FROM asked a JOIN ver v ON v.kind = 1 AND v.id = a.item_id AND v.ts < a.ts GROUP BY ALL)"""
_DOT = " + ".join(f"(coalesce(u.vec[{i + 1}], 0) + ln(1 + greatest(a.ts, 0)) * {_WEIGHT[i]} + {_BIAS[i]}) * coalesce(v.vec[{i + 1}], 0)" for i in range(_SIZE))


@register(
    "temporal_memory_scores",
    sql.query(
        sql.EVENTS,
        sql.SPLIT,
        sql.CASES,
        sql.RETRIEVAL,
        _FIXED,
        select=f"""SELECT a.event_id, a.item_id, round({_DOT}, 6) AS score FROM asked a
LEFT JOIN own o ON o.event_id = a.event_id AND o.item_id = a.item_id LEFT JOIN touched t ON t.event_id = a.event_id AND t.item_id = a.item_id
LEFT JOIN e u ON u.place = o.place LEFT JOIN e v ON v.place = t.place""",
    ),
)
def _(spark, folder):
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    fixed = vectors.select((F.row_number().over(Window.orderBy("vec_id")) - 1).cast("long").alias("place"), F.slice("embedding", 1, _SIZE).cast("array<double>").alias("vec"))
    train, m = train_events(spark, folder), F.lit(vectors.count())
    touched = train.select(F.lit(temporal.USER).alias("kind"), F.col("user_id").alias("id"), "ts", "event_id", (F.col("event_id") % m).alias("place"))
    touched = touched.union(train.select(F.lit(temporal.ITEM), "item_id", "ts", "event_id", (F.col("event_id") + 1) % m))
    versions = touched.join(fixed, "place").select("kind", "id", "ts", F.lit(0).alias("slice"), F.col("event_id").alias("seq"), "vec")
    return rounded(temporal.scores(_asked(spark, folder), versions, _WEIGHT, _BIAS).select("event_id", "item_id", "score"))


@register("temporal_graph_ranks")
def _(spark, folder):
    """Memories replayed over the training events in 8 slices, and each case's candidates ranked by them."""
    train, encoder = train_events(spark, folder), temporal.Encoder.drawn(_SIZE)
    versions = temporal.replay(train, encoder, temporal.time_bounds(train, 8))
    return rounded(temporal.ranked(_asked(spark, folder), versions, encoder).select("event_id", "item_id", "score", "rank"))
