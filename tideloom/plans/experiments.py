"""Queries: perturbations, stress sets, samples and plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideloom.functions.cuts import cut
from tideloom.operators import graph, metrics, perturb, rank, runs, semantic, sequences, stats
from tideloom.plans import sql
from tideloom.plans.base import rounded, split_events, train_events
from tideloom.plans.ranking import _INDEX, _NEG_SQL, _OVERLAP, _POP, _negatives, _stress_inputs
from tideloom.plans.registry import register
from tideloom.sources.tables import event_interactions, order_interactions

_VARIANTS = """h AS (SELECT user_id, list(item_id ORDER BY ts, event_id) AS items FROM loo WHERE split = 'train' GROUP BY user_id),
p AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM loo WHERE split = 'train'),
v AS (SELECT user_id, 'original' AS variant, items FROM h UNION ALL SELECT user_id, 'reversed', list_reverse(items) FROM h UNION ALL SELECT user_id, 'recent_5', items[-5:] FROM h
  UNION ALL SELECT user_id, 'remove_recent_5', items[1:greatest(len(items) - 5, 0)] FROM h
  UNION ALL SELECT user_id, 'shuffled_seed_0', list(item_id ORDER BY sha256('0|' || user_id || '|' || i || '|' || item_id), item_id) FROM p GROUP BY user_id)"""
_PERTURBED = f"""{_VARIANTS},
r AS (SELECT user_id, variant, unnest(items[-5:]) AS source_id FROM v),
sc AS (SELECT r.user_id, variant, target_id AS item_id, sum(count)::DOUBLE AS score FROM r JOIN moves USING (source_id) WHERE NOT EXISTS (SELECT 1 FROM loo l WHERE l.split = 'train' AND l.user_id = r.user_id AND l.item_id = moves.target_id) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY user_id, variant ORDER BY score DESC, item_id) AS rank FROM sc),
tg AS (SELECT v.user_id, v.variant, rk.rank FROM v JOIN loo t ON t.user_id = v.user_id AND t.split = 'val' LEFT JOIN rk ON rk.user_id = v.user_id AND rk.variant = v.variant AND rk.item_id = t.item_id)"""


def _variants(spark, folder):
    return perturb.variants(sequences.histories(train_events(spark, folder)))


def _ranked(spark, folder):
    train = train_events(spark, folder)
    seen = train.select("user_id", "item_id").distinct()
    scored = perturb.retrieve(_variants(spark, folder), graph.transition_edges(train), seen)
    return rank.top_k(scored, ["user_id", "variant"], 1 << 30)


def _target_ranks(spark, folder):
    targets = split_events(spark, folder).where("split = 'val'").select("user_id", "item_id")
    cases = _variants(spark, folder).select("user_id", "variant").join(targets, "user_id")
    return cases.join(_ranked(spark, folder).select("user_id", "variant", "item_id", "rank"), ["user_id", "variant", "item_id"], "left").select("user_id", "variant", "rank")


@register("perturbed_histories", sql.query(sql.EVENTS, sql.SPLIT, _VARIANTS, select="SELECT user_id, variant, array_to_string(items, ',') AS items FROM v"))
def _(spark, folder):
    return _variants(spark, folder).withColumn("items", F.array_join(F.col("items").cast("array<string>"), ","))


@register("perturbation_metrics", sql.query(sql.EVENTS, sql.SPLIT, sql.ALL_TRANSITIONS, _PERTURBED, select=f"SELECT variant, {sql.ranking_columns((5, 10))} FROM tg GROUP BY variant"))
def _(spark, folder):
    return rounded(metrics.ranking(_target_ranks(spark, folder), (5, 10), ["variant"]).where("variant is not null"))


@register(
    "perturbation_rank_changes",
    sql.query(sql.EVENTS, sql.SPLIT, sql.ALL_TRANSITIONS, _PERTURBED, select="SELECT a.user_id, a.variant, a.rank, b.rank AS base_rank, a.rank - b.rank AS rank_delta, coalesce((a.rank <= 10)::INT, 0) - coalesce((b.rank <= 10)::INT, 0) AS hit_delta FROM tg a JOIN tg b ON a.user_id = b.user_id AND b.variant = 'original' AND a.variant <> 'original'"),
)
def _(spark, folder):
    return perturb.rank_changes(_target_ranks(spark, folder), ["user_id"])


@register(
    "perturbation_overlap",
    sql.query(sql.EVENTS, sql.SPLIT, sql.ALL_TRANSITIONS, _PERTURBED, "a AS (SELECT * FROM rk WHERE variant = 'reversed' AND rank <= 10)", "b AS (SELECT * FROM rk WHERE variant = 'original' AND rank <= 10)", "j AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, a.rank + b.rank AS s FROM a FULL JOIN b ON a.user_id = b.user_id AND a.item_id = b.item_id)", select="SELECT user_id, round(count(s) / count(*), 6) AS overlap FROM j GROUP BY user_id"),
)
def _(spark, folder):
    ranked = _ranked(spark, folder)
    return rounded(stats.overlap(ranked.where("variant = 'reversed'"), ranked.where("variant = 'original'"), ["user_id"], 10).select("user_id", "overlap"))


def _order_history(spark, folder):
    rows = order_interactions(spark, folder).groupBy("user_id", "item_id", "ts").agg(F.count("*").alias("event_id"))
    last = rows.groupBy("user_id").agg(F.max("ts").alias("case_ts"))
    return rows.join(last, "user_id").where("ts < case_ts").select(F.col("user_id").alias("case_id"), "case_ts", "ts", F.col("item_id").alias("event_id"), "item_id")


@register(
    "swapped_times",
    sql.query(
        sql.ORDERS,
        "q AS (SELECT DISTINCT user_id, item_id, ts, max(ts) OVER (PARTITION BY user_id) AS case_ts FROM ib)",
        "s AS (SELECT user_id AS case_id, item_id, ts, case_ts, CASE WHEN case_ts - ts <= 20000000 THEN 'near' WHEN case_ts - ts > 60000000 THEN 'far' END AS side FROM q WHERE ts < case_ts)",
        "n AS (SELECT *, row_number() OVER (PARTITION BY case_id, side ORDER BY ts, item_id) AS n FROM s)",
        select="SELECT a.case_id, a.item_id, a.ts, coalesce(b.ts, a.ts) AS swapped_ts FROM n a LEFT JOIN n b ON a.case_id = b.case_id AND a.n = b.n AND a.side <> b.side",
    ),
)
def _(spark, folder):
    return perturb.swap_far_and_near(_order_history(spark, folder), near=20_000_000, far=60_000_000).select("case_id", "item_id", "ts", "swapped_ts")


@register(
    "random_times",
    sql.query(
        sql.ORDERS,
        "q AS (SELECT DISTINCT user_id, item_id, ts, max(ts) OVER (PARTITION BY user_id) AS case_ts FROM ib)",
        "h AS (SELECT user_id AS case_id, item_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, item_id) AS by_time, row_number() OVER (PARTITION BY user_id ORDER BY sha256('3|' || user_id || '|' || item_id)) AS by_hash FROM q WHERE ts < case_ts)",
        select="SELECT a.case_id, a.item_id, b.ts FROM h a JOIN h b ON b.case_id = a.case_id AND b.by_time = a.by_hash",
    ),
)
def _(spark, folder):
    return perturb.random_times(_order_history(spark, folder), 3).select("case_id", "item_id", "ts")


@register(
    "window_rank_topk",
    sql.query(
        sql.EVENTS,
        sql.SPLIT,
        "h AS (SELECT user_id, list(item_id ORDER BY ts, event_id) AS items FROM loo WHERE split = 'train' GROUP BY user_id)",
        "we AS (SELECT a.item_id AS s, b.item_id AS t, count(*)::DOUBLE AS w FROM loo a JOIN loo b ON a.user_id = b.user_id AND (a.ts, a.event_id) < (b.ts, b.event_id) AND b.ts - a.ts <= 86400 WHERE a.split = 'train' AND b.split = 'train' GROUP BY ALL)",
        "ww AS (SELECT s, t, sum(w) AS w FROM (SELECT s, t, w FROM we UNION ALL SELECT t, s, w FROM we) GROUP BY ALL)",
        "r AS (SELECT user_id, unnest(items[-5:]) AS s FROM h)",
        "sc AS (SELECT r.user_id, c.item_id, sum(coalesce(w, 0)) AS score FROM r CROSS JOIN (SELECT DISTINCT item_id FROM loo WHERE split = 'train') c LEFT JOIN ww ON ww.s = r.s AND ww.t = c.item_id GROUP BY ALL)",
        select="SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM sc QUALIFY rank <= 5",
    ),
)
def _(spark, folder):
    train = train_events(spark, folder)
    return perturb.window_rank_top_k(sequences.histories(train), train, graph.window_edges(train, 86_400), 5)


@register(
    "stress_rates",
    sql.query(
        sql.EVENTS,
        sql.SPLIT,
        sql.CASES,
        sql.TRAIN_PAIRS,
        sql.EDGES,
        _POP,
        _INDEX,
        _OVERLAP,
        _NEG_SQL,
        "sn AS (SELECT event_id, first(struct_pack(o := overlap, s := score) ORDER BY overlap DESC, support > 0, score, popularity DESC, item_id) FILTER (overlap > 0) AS semantic, max(score) AS best FROM rows GROUP BY event_id)",
        "tg AS (SELECT c.event_id, coalesce(ov.shared, 0) AS o, coalesce(e.p, 0) AS s FROM cases c JOIN prev USING (event_id) LEFT JOIN ov ON ov.item_id = prev.source_id AND ov.other_id = c.item_id LEFT JOIN (SELECT source_id, target_id, support / sum(support) OVER (PARTITION BY source_id) AS p FROM edges) e ON e.source_id = prev.source_id AND e.target_id = c.item_id)",
        select="""SELECT count(*) AS cases, round(avg((semantic IS NOT NULL)::INT), 6) AS semantic_coverage, round(avg((best > 0)::INT), 6) AS transition_coverage,
      round(avg(CASE WHEN semantic IS NOT NULL THEN (semantic.o >= tg.o)::INT END), 6) AS semantic_trap_rate, round(avg(CASE WHEN tg.s > 0 AND semantic IS NOT NULL THEN (tg.s > semantic.s)::INT END), 6) AS transition_win_rate FROM sn JOIN tg USING (event_id)""",
    ),
)
def _(spark, folder):
    inputs = _stress_inputs(spark, folder)
    cases, _, _, previous, edges, close = inputs
    negatives, moves = cut(_negatives(spark, folder, inputs)), edges.drop("support")

    def measured(items, name):
        found = previous.join(items, "event_id").join(close, ["source_id", "item_id"], "left").join(moves, ["source_id", "item_id"], "left")
        return found.select("event_id", F.coalesce("shared", F.lit(0)).alias(f"{name}_overlap"), F.coalesce("transition_probability", F.lit(0.0)).alias(f"{name}_score"))

    target = measured(cases.select("event_id", "item_id"), "target")
    negative = measured(negatives.select("event_id", F.col("semantic_negative").alias("item_id")).where("item_id is not null"), "negative")
    return rounded(semantic.stress_rates(negatives.join(target, "event_id").join(negative, "event_id", "left")))


@register("sampled_cases", sql.query(sql.EVENTS, "o AS (SELECT user_id, min(domain) AS domain FROM ia GROUP BY 1)", select="SELECT user_id AS case_id, domain, row_number() OVER (PARTITION BY domain ORDER BY sha256('0|' || user_id)) AS place FROM o QUALIFY place <= 4"))
def _(spark, folder):
    return runs.sample_cases(event_interactions(spark, folder).withColumnRenamed("user_id", "case_id"), "domain", 4)


@register("job_queue", "SELECT r_name AS dataset, method, seed::INT AS seed, 'job_' || r_name || '_' || method || '_' || seed AS job_id, 'planned' AS status FROM region CROSS JOIN (VALUES ('bm25'), ('markov')) m(method) CROSS JOIN (VALUES (1), (2)) s(seed)")
def _(spark, folder):
    names = spark.read.parquet(f"{folder}/region.parquet").select(F.col("r_name").alias("dataset"))
    return runs.job_queue(names, spark.createDataFrame([("bm25",), ("markov",)], "method string"), spark.createDataFrame([(1,), (2,)], "seed int"))


@register(
    "sft_rows",
    sql.query(
        sql.EVENTS,
        sql.SPLIT,
        "x AS (SELECT event_id, item_id, array_to_string(list(item_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), ', ') AS h FROM loo WHERE split = 'train')",
        select="""SELECT event_id, '{"messages":[{"role":"system","content":"You recommend items."},{"role":"user","content":"History: ' || h || '"},{"role":"assistant","content":"' || item_id || '"}]}' AS row FROM x WHERE h <> ''""",
    ),
)
def _(spark, folder):
    return runs.sft_rows(sequences.prefixes(split_events(spark, folder), 5))


@register("sft_leaks", sql.query(sql.EVENTS, sql.SPLIT, select="SELECT event_id FROM (SELECT event_id, split, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM loo) WHERE split <> 'train' AND n > 1"))
def _(spark, folder):
    """The audit of rows that were built from every event, as if all were training events: it must name those that are not."""
    events = split_events(spark, folder)
    careless = runs.sft_rows(sequences.prefixes(events.withColumn("split", F.lit("train")), 5))
    return runs.sft_leaks(careless, events).select("event_id")


@register("mean_metrics", sql.query(sql.EVENTS, select="SELECT domain, round(avg(user_id), 6) AS user_id, round(avg(rating), 6) AS rating FROM ia GROUP BY domain"))
def _(spark, folder):
    return rounded(runs.mean_metrics(event_interactions(spark, folder).select("domain", "user_id", "rating"), ["domain"]))
