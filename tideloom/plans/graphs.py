"""Queries: item graphs and as-of retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideloom.operators import asof, graph, metrics, rank
from tideloom.plans import sql
from tideloom.plans.base import catalogue, rounded, split_events, test_cases, train_edges, train_events
from tideloom.plans.registry import register
from tideloom.sources.tables import event_interactions, order_interactions, part_items

_EDGE_SQL = """SELECT e.source_id, e.target_id, e.support, round(e.support / o.n, 6) AS transition_probability, round(e.support * t.n / (o.n * i.n), 6) AS lift,
  round(ln(e.support * t.n / (o.n * i.n)), 6) AS pmi, round((e.support - coalesce(b.support, 0)) / (e.support + coalesce(b.support, 0)), 6) AS direction_asymmetry,
  e.first_ts, e.last_ts, round(e.mean_ts, 6) AS mean_ts, round(e.mean_gap, 6) AS mean_gap, e.gap_same_session, e.gap_within_1d, e.gap_within_1w, e.gap_within_1m, e.gap_long_gap
FROM full_edges e JOIN (SELECT source_id, sum(support)::DOUBLE AS n FROM full_edges GROUP BY 1) o USING (source_id)
JOIN (SELECT target_id, sum(support)::DOUBLE AS n FROM full_edges GROUP BY 1) i USING (target_id)
CROSS JOIN (SELECT sum(support)::DOUBLE AS n FROM full_edges) t
LEFT JOIN full_edges b ON b.source_id = e.target_id AND b.target_id = e.source_id"""
_FULL = """full_edges AS (
  SELECT source_id, target_id, count(*) AS support, min(target_ts) AS first_ts, max(target_ts) AS last_ts, avg(target_ts) AS mean_ts, avg(gap) AS mean_gap,
         count(*) FILTER (gap <= 1800) AS gap_same_session, count(*) FILTER (gap > 1800 AND gap <= 86400) AS gap_within_1d, count(*) FILTER (gap > 86400 AND gap <= 604800) AS gap_within_1w,
         count(*) FILTER (gap > 604800 AND gap <= 2592000) AS gap_within_1m, count(*) FILTER (gap > 2592000) AS gap_long_gap
  FROM pairs GROUP BY ALL)"""


@register("tdig_edges", sql.query(sql.EVENTS, sql.SPLIT, sql.TRAIN_PAIRS, _FULL, select=_EDGE_SQL))
def _(spark, folder):
    return rounded(train_edges(spark, folder))


_TIED = """pairs AS (
  SELECT * FROM (SELECT user_id, lag(item_id) OVER w AS source_id, item_id AS target_id, lag(ts) OVER w AS source_ts, ts AS target_ts, ts - lag(ts) OVER w AS gap
    FROM ib WINDOW w AS (PARTITION BY user_id ORDER BY ts, item_id, rating)) WHERE source_id IS NOT NULL"""
_ORDER = ("ts", "item_id", "rating")


@register("tdig_edges_tied_skip", sql.query(sql.ORDERS, _TIED + " AND gap > 0)", select="SELECT source_id, target_id, count(*) AS support, round(avg(gap), 6) AS mean_gap FROM pairs GROUP BY ALL"))
def _(spark, folder):
    return rounded(graph.tdig_edges(graph.transitions(order_interactions(spark, folder), _ORDER)).select("source_id", "target_id", "support", "mean_gap"))


@register("tdig_edges_tied_kept", sql.query(sql.ORDERS, _TIED + ")", select="SELECT source_id, target_id, count(*) AS support, round(avg(gap), 6) AS mean_gap FROM pairs GROUP BY ALL"))
def _(spark, folder):
    return rounded(graph.tdig_edges(graph.transitions(order_interactions(spark, folder), _ORDER, include_ties=True)).select("source_id", "target_id", "support", "mean_gap"))


@register(
    "strict_transitions",
    sql.query(sql.ORDERS, "s AS (SELECT *, count(*) OVER (PARTITION BY user_id, ts) AS n FROM ib)", select="""SELECT user_id, source_id, target_id, source_ts, target_ts, target_ts - source_ts AS gap FROM (
      SELECT user_id, lag(item_id) OVER w AS source_id, item_id AS target_id, lag(ts) OVER w AS source_ts, ts AS target_ts, lag(n) OVER w AS b FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, item_id, rating))
      WHERE source_ts < target_ts AND b = 1"""),
)
def _(spark, folder):
    return graph.strict_transitions(order_interactions(spark, folder), _ORDER).select("user_id", "source_id", "target_id", "source_ts", "target_ts", "gap")


@register(
    "tie_skips",
    sql.query(sql.ORDERS, "q AS (SELECT user_id, ts, count(*) AS n FROM ib GROUP BY ALL), m AS (SELECT *, max(ts) OVER (PARTITION BY user_id) AS last FROM q)", select="SELECT count(*) AS tied_groups, coalesce(sum(n - 1), 0)::BIGINT AS tied_pairs, count(*) FILTER (last > ts) AS bridges FROM m WHERE n > 1"),
)
def _(spark, folder):
    return graph.tie_skips(order_interactions(spark, folder))


_TOP = "SELECT source_id, target_id, support, round(p, 6) AS transition_probability, rank FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY {by} DESC, support DESC, last_ts DESC, target_id) AS rank FROM (SELECT *, support / sum(support) OVER (PARTITION BY source_id) AS p FROM full_edges)) WHERE rank <= 5"


@register("tdig_topk", sql.query(sql.EVENTS, sql.SPLIT, sql.TRAIN_PAIRS, _FULL, select=_TOP.format(by="p")))
def _(spark, folder):
    return rounded(graph.top_targets(train_edges(spark, folder), 5).select("source_id", "target_id", "support", "transition_probability", "rank"))


@register("tdig_gap_topk", sql.query(sql.EVENTS, sql.SPLIT, sql.TRAIN_PAIRS, _FULL, select=_TOP.format(by="gap_within_1d")))
def _(spark, folder):
    return rounded(graph.top_targets(train_edges(spark, folder), 5, "gap_within_1d").select("source_id", "target_id", "support", "transition_probability", "rank"))


_MOVE = "source_id, target_id, count, user_count, round(mean_gap, 6) AS mean_gap, round(median_gap, 6) AS median_gap, n_same_session, n_same_day, n_same_week, n_same_month, n_old, n_unknown"


@register("transition_edges", sql.query(sql.EVENTS, sql.SPLIT, sql.ALL_TRANSITIONS, select=f"SELECT {_MOVE} FROM moves"))
def _(spark, folder):
    return rounded(graph.transition_edges(train_events(spark, folder)))


@register(
    "decayed_transition_edges",
    sql.query(sql.EVENTS, sql.SPLIT, sql.ALL_TRANSITIONS, select="SELECT source_id, target_id, count, round(CASE WHEN mean_gap IS NULL THEN count ELSE count * pow(0.5, mean_gap / 86400) END, 6) AS weight FROM moves"),
)
def _(spark, folder):
    return rounded(graph.decayed(graph.transition_edges(train_events(spark, folder)), 86_400).select("source_id", "target_id", "count", "weight"))


@register(
    "transition_edge_summary",
    sql.query(
        sql.EVENTS,
        sql.SPLIT,
        sql.ALL_TRANSITIONS,
        "s AS (SELECT count(*) AS edges, sum(user_count)::BIGINT AS users, sum(count)::BIGINT AS weight, sum(n_same_session) AS a, sum(n_same_day) AS b, sum(n_same_week) AS c, sum(n_same_month) AS d, sum(n_old) AS e FROM moves)",
        select="SELECT edges, users, weight, (SELECT k FROM (VALUES ('same_session', a), ('same_day', b), ('same_week', c), ('same_month', d), ('old', e)) v(k, n) ORDER BY n DESC, k LIMIT 1) AS dominant_bucket FROM s",
    ),
)
def _(spark, folder):
    return graph.edge_summary(graph.transition_edges(train_events(spark, folder)), "count", "user_count", ["n_same_session", "n_same_day", "n_same_week", "n_same_month", "n_old"])


@register(
    "transition_coverage",
    sql.query(sql.EVENTS, sql.SPLIT, sql.TRAIN_PAIRS, sql.EDGES, "t AS (SELECT source_id AS i FROM edges UNION SELECT target_id FROM edges)", select="SELECT count(*) AS items, count(t.i) AS touched, round(count(t.i) / count(*), 6) AS coverage, (SELECT round(avg(support), 6) FROM edges) AS mean_support FROM part LEFT JOIN t ON t.i = p_partkey"),
)
def _(spark, folder):
    return rounded(graph.coverage(train_edges(spark, folder), part_items(spark, folder)))


def _window_sql(seconds: int, where: str = "", source: str = "a.item_id", target: str = "b.item_id", weight: str = "count(*)::DOUBLE", name: str = "we") -> str:
    return f"""{name} AS (SELECT {source} AS source_id, {target} AS target_id, count(*) AS count, count(DISTINCT a.user_id) AS user_count, avg(b.ts - a.ts) AS mean_gap, {weight} AS weight
  FROM loo a JOIN loo b ON a.user_id = b.user_id AND (a.ts, a.event_id) < (b.ts, b.event_id) AND b.ts - a.ts <= {seconds} WHERE a.split = 'train' AND b.split = 'train' {where} GROUP BY ALL)"""


_WE = "SELECT source_id, target_id, count, user_count, round(mean_gap, 6) AS mean_gap, round(weight, 6) AS weight FROM we"


@register("window_edges_count", sql.query(sql.EVENTS, sql.SPLIT, _window_sql(86_400), select=_WE))
def _(spark, folder):
    return rounded(graph.window_edges(train_events(spark, folder), 86_400))


@register(
    "window_edges_decay",
    sql.query(
        sql.EVENTS,
        sql.SPLIT,
        _window_sql(86_400, source="CASE WHEN a.item_id::VARCHAR > b.item_id::VARCHAR THEN b.item_id ELSE a.item_id END", target="CASE WHEN a.item_id::VARCHAR > b.item_id::VARCHAR THEN a.item_id ELSE b.item_id END", weight="sum(pow(0.5, (b.ts - a.ts) / 43200))"),
        select=_WE,
    ),
)
def _(spark, folder):
    return rounded(graph.window_edges(train_events(spark, folder), 86_400, directed=False, half_life=43_200))


_WINDOWS = {"1h": 3600, "1d": 86_400, "7d": 604_800}


@register(
    "window_sweep",
    sql.query(sql.EVENTS, sql.SPLIT, *[_window_sql(s, name=f"w{n}") for n, s in _WINDOWS.items()], select=" UNION ALL ".join(f"SELECT count(*) AS edges, sum(count)::BIGINT AS pairs, sum(user_count)::BIGINT AS users, '{n}' AS \"window\" FROM w{n}" for n in _WINDOWS)),
)
def _(spark, folder):
    return graph.window_sweep(train_events(spark, folder), _WINDOWS)


@register(
    "asof_popularity",
    sql.query(sql.EVENTS, sql.SPLIT, sql.CASES, select="SELECT c.event_id, c.item_id, (SELECT count(*) FROM loo t WHERE t.split = 'train' AND t.item_id = c.item_id AND t.ts < c.ts) AS popularity FROM cases c"),
)
def _(spark, folder):
    return asof.popularity(test_cases(spark, folder), train_events(spark, folder)).select("event_id", "item_id", "popularity")


@register("asof_sources", sql.query(sql.EVENTS, sql.SPLIT, sql.CASES, sql.RETRIEVAL, select="SELECT * FROM sources"))
def _(spark, folder):
    return asof.sources_of(test_cases(spark, folder), split_events(spark, folder).where("split <> 'test'"), 20)


@register("asof_candidates", sql.query(sql.EVENTS, sql.SPLIT, sql.CASES, sql.RETRIEVAL, select="SELECT event_id, candidate_id, round(score, 6) AS score, rank FROM retrieved WHERE rank <= 50"))
def _(spark, folder):
    return rounded(asof.retrieve(test_cases(spark, folder), split_events(spark, folder)).where("rank <= 50"))


@register("asof_recall_cases", sql.query(sql.EVENTS, sql.SPLIT, sql.CASES, sql.RETRIEVAL, select="SELECT * FROM ranks"))
def _(spark, folder):
    cases = test_cases(spark, folder)
    return asof.target_ranks(cases, asof.retrieve(cases, split_events(spark, folder))).select("event_id", "user_id", "item_id", "ts", "rank")


@register("asof_recall_metrics", sql.query(sql.EVENTS, sql.SPLIT, sql.CASES, sql.RETRIEVAL, select=f"SELECT {sql.ranking_columns((5, 10, 20))} FROM ranks"))
def _(spark, folder):
    cases = test_cases(spark, folder)
    return rounded(metrics.ranking(asof.target_ranks(cases, asof.retrieve(cases, split_events(spark, folder))), (5, 10, 20)))


_COO = """f AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY t, e) AS p FROM (SELECT user_id, item_id, min(ts) AS t, arg_min(event_id, (ts, event_id)) AS e FROM loo WHERE split = 'train' GROUP BY ALL)),
co AS (SELECT a.item_id, b.item_id AS neighbor_id, count(*) AS count FROM f a JOIN f b ON a.user_id = b.user_id AND a.item_id <> b.item_id AND abs(a.p - b.p) <= 30 GROUP BY ALL)"""


@register("item_cooccurrence", sql.query(sql.EVENTS, sql.SPLIT, _COO, select="SELECT * FROM co"))
def _(spark, folder):
    return asof.cooccurrence(train_events(spark, folder), 30)


_SEEN_ALL = "seen AS (SELECT DISTINCT c.event_id, m.item_id FROM cases c JOIN loo m ON m.user_id = c.user_id AND m.split <> 'test' AND m.ts < c.ts AND m.item_id <> c.item_id)"


def _full_rank_sql(scores: str) -> str:
    return f"""{_SEEN_ALL}, {scores},
grid AS (SELECT c.event_id, c.item_id AS target, p.item_id, coalesce(s.score, 0) AS score FROM cases c CROSS JOIN (SELECT p_partkey AS item_id FROM part WHERE p_partkey IN (SELECT item_id FROM ia)) p
  LEFT JOIN scores s ON s.event_id = c.event_id AND s.item_id = p.item_id WHERE NOT EXISTS (SELECT 1 FROM seen x WHERE x.event_id = c.event_id AND x.item_id = p.item_id)),
placed AS (SELECT event_id, item_id, target, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, item_id) AS rank FROM grid)"""


_PLACED = "SELECT event_id, item_id, rank FROM placed WHERE item_id = target"


def _seen(spark, folder):
    return asof.seen_before(test_cases(spark, folder), split_events(spark, folder).where("split <> 'test'"))


@register("popularity_full_ranking", sql.query(sql.EVENTS, sql.SPLIT, sql.CASES, _full_rank_sql("scores AS (SELECT event_id, item_id, n::DOUBLE AS score FROM cases_ids CROSS JOIN pop)").replace("seen AS", "cases_ids AS (SELECT event_id FROM cases), pop AS (SELECT item_id, count(*) AS n FROM loo WHERE split = 'train' GROUP BY 1), seen AS", 1), select=_PLACED))
def _(spark, folder):
    cases = test_cases(spark, folder)
    return asof.popularity_rank(cases, rank.popularity(train_events(spark, folder)), catalogue(spark, folder), _seen(spark, folder))


@register(
    "item_knn_full_ranking",
    sql.query(
        sql.EVENTS,
        sql.SPLIT,
        sql.CASES,
        _COO,
        "nb AS (SELECT * FROM co QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY count DESC, neighbor_id) <= 20)",
        _full_rank_sql("src AS (SELECT DISTINCT c.event_id, m.item_id FROM cases c JOIN loo m ON m.user_id = c.user_id AND m.split <> 'test' AND m.ts < c.ts), scores AS (SELECT event_id, neighbor_id AS item_id, sum(count)::DOUBLE AS score FROM src JOIN nb USING (item_id) GROUP BY ALL)"),
        select=_PLACED,
    ),
)
def _(spark, folder):
    cases = test_cases(spark, folder)
    scores = asof.item_knn(cases, split_events(spark, folder).where("split <> 'test'"), asof.cooccurrence(train_events(spark, folder), 30), 20)
    return asof.full_rank(cases, scores.withColumn("score", F.col("score").cast("double")), catalogue(spark, folder), _seen(spark, folder))


@register(
    "session_lengths",
    sql.query(sql.EVENTS, "m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1800 THEN 1 ELSE 0 END AS n FROM ia)", "s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM m)", select="SELECT user_id, min(ts) AS first_ts, count(*) AS events FROM s GROUP BY user_id, s"),
)
def _(spark, folder):
    events = event_interactions(spark, folder).withColumn("at", F.timestamp_seconds("ts"))
    return events.groupBy("user_id", F.session_window("at", "1800 seconds")).agg(F.min("ts").alias("first_ts"), F.count("*").alias("events")).select("user_id", "first_ts", "events")
