"""Queries: evidence, prompts, answers, costs, factor models and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tideloom.functions.cuts import cut, shared_folder
from tideloom.operators import asof, evidence, graph, metrics, models, prompts, rank, sequences
from tideloom.plans import sql
from tideloom.plans.base import catalogue, rounded, split_events, test_cases, train_events
from tideloom.plans.registry import register
from tideloom.sources.tables import event_interactions, table
from tideloom.streaming import transitions as streams

_BUCKETS = ("n_same_session", "n_same_day", "n_same_week", "n_same_month", "n_old")


def _inputs(spark, folder):
    cases, events = test_cases(spark, folder), split_events(spark, folder)
    sources = asof.sources_of(cases, events.where("split <> 'test'"), 3).withColumnRenamed("event_id", "case_id")
    candidates = rank.resolve_pool(cases, rank.pool(event_interactions(spark, folder), 20), 20).select(F.col("event_id").alias("case_id"), F.col("item_id").alias("target_id"))
    edges = graph.transition_edges(train_events(spark, folder)).withColumn("gap_bucket", evidence.dominant_bucket(_BUCKETS))
    return sources, candidates, edges, catalogue(spark, folder)


def _histories(spark, folder):
    cases = test_cases(spark, folder).select(F.col("event_id").alias("case_id"), "user_id")
    return cases.join(sequences.histories(train_events(spark, folder)), "user_id").select("case_id", "items")


def _evidence(spark, folder):
    sources, candidates, edges, items = _inputs(spark, folder)
    pairs = evidence.probe(sources, candidates)
    alike = evidence.similar(pairs, items, ["title", "brand"])
    edges = cut(edges)
    parts = [
        evidence.transition_evidence(pairs, edges),
        evidence.window_evidence(pairs, graph.window_edges(train_events(spark, folder), 86_400)),
        evidence.semantic_evidence(alike),
        evidence.contrastive_evidence(alike, edges),
        evidence.history_evidence(pairs),
        evidence.drift_evidence(_histories(spark, folder), candidates, items),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_RING = "ring AS (SELECT item_id, row_number() OVER (ORDER BY sha256('0|' || item_id), item_id) - 1 AS place FROM (SELECT DISTINCT item_id FROM ia))"
_CASE = f"""mine AS (SELECT * FROM loo WHERE split <> 'test'),
src AS (SELECT event_id AS case_id, source_id, recency FROM (SELECT event_id, source_id, row_number() OVER (PARTITION BY event_id ORDER BY t DESC, e DESC) AS recency FROM (
  SELECT c.event_id, m.item_id AS source_id, max(m.ts) AS t, arg_max(m.event_id, (m.ts, m.event_id)) AS e FROM cases c JOIN mine m ON m.user_id = c.user_id AND m.ts < c.ts GROUP BY ALL)) WHERE recency <= 3),
{_RING},
p AS (SELECT item_id, place FROM ring WHERE place < 20),
cand AS (SELECT c.event_id AS case_id, p.item_id AS target_id FROM cases c CROSS JOIN p WHERE c.item_id IN (SELECT item_id FROM p) OR p.place < 19 UNION ALL SELECT event_id, item_id FROM cases WHERE item_id NOT IN (SELECT item_id FROM p)),
moves2 AS (SELECT *, CASE WHEN greatest(n_same_session, n_same_day, n_same_week, n_same_month, n_old) = 0 THEN NULL ELSE
  (SELECT k FROM (VALUES ('same_session', n_same_session), ('same_day', n_same_day), ('same_week', n_same_week), ('same_month', n_same_month), ('old', n_old)) v(k, n) ORDER BY n DESC, k LIMIT 1) END AS gap_bucket FROM moves),
probe AS (SELECT case_id, source_id, recency, target_id FROM src JOIN cand USING (case_id)),
we AS (SELECT a.item_id AS source_id, b.item_id AS target_id, count(*)::DOUBLE AS weight, avg(b.ts - a.ts) AS mean_gap
  FROM loo a JOIN loo b ON a.user_id = b.user_id AND (a.ts, a.event_id) < (b.ts, b.event_id) AND b.ts - a.ts <= 86400 WHERE a.split = 'train' AND b.split = 'train' GROUP BY ALL),
bags AS (SELECT p_partkey AS item_id, p_type AS category, list_distinct(list_filter(regexp_extract_all(lower(concat_ws(' ', p_name, p_brand)), '[a-z0-9]+'), lambda t: len(t) >= 2 AND regexp_matches(t, '[a-z]') AND t NOT IN ('a', 'an', 'and', 'by', 'for', 'from', 'in', 'item', 'movie', 'of', 'on', 'or', 'the', 'to', 'with'))) AS t FROM part WHERE p_partkey IN (SELECT item_id FROM ia)),
sim AS (SELECT probe.*, len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) AS similarity FROM probe JOIN bags a ON a.item_id = source_id JOIN bags b ON b.item_id = target_id WHERE source_id <> target_id),
halves AS (SELECT event_id AS case_id, l.item_id, row_number() OVER (PARTITION BY event_id ORDER BY l.ts, l.event_id2) - 1 AS p, count(*) OVER (PARTITION BY event_id) AS n FROM cases c JOIN (SELECT user_id, item_id, ts, event_id AS event_id2 FROM loo WHERE split = 'train') l USING (user_id)),
kinds AS (SELECT case_id, CASE WHEN p < n // 2 THEN 'old' ELSE 'new' END AS half, category, count(*) AS k FROM halves JOIN bags USING (item_id) WHERE n >= 2 GROUP BY ALL),
dom AS (SELECT case_id, half, category FROM kinds QUALIFY row_number() OVER (PARTITION BY case_id, half ORDER BY k DESC, category) = 1),
drift AS (SELECT o.case_id, o.category AS drift_from, n.category AS drift_to FROM dom o JOIN dom n ON o.case_id = n.case_id AND o.half = 'old' AND n.half = 'new' AND o.category <> n.category),
ev AS (
  SELECT case_id, 'transition' AS evidence_type, source_id, target_id, count AS transition_count, NULL::DOUBLE AS window_score, NULL::DOUBLE AS similarity, NULL::DOUBLE AS recent_signal, mean_gap, gap_bucket, NULL AS drift_from, NULL AS drift_to FROM probe JOIN moves2 USING (source_id, target_id)
  UNION ALL SELECT case_id, 'time_window', source_id, target_id, NULL, weight, NULL, NULL, mean_gap, NULL, NULL, NULL FROM probe JOIN we USING (source_id, target_id)
  UNION ALL SELECT case_id, 'semantic', source_id, target_id, NULL, NULL, similarity, NULL, NULL, NULL, NULL, NULL FROM sim WHERE similarity >= 0.2
  UNION ALL SELECT case_id, 'contrastive', source_id, target_id, count, NULL, similarity, NULL, NULL, gap_bucket, NULL, NULL FROM sim JOIN moves2 USING (source_id, target_id) WHERE similarity <= 0.1
  UNION ALL SELECT case_id, 'history', source_id, target_id, NULL, NULL, NULL, 1.0::DOUBLE / recency, NULL, NULL, NULL, NULL FROM probe
  UNION ALL SELECT case_id, 'user_drift', NULL, target_id, NULL, NULL, NULL, NULL, NULL, NULL, drift_from, drift_to FROM drift JOIN cand USING (case_id) JOIN bags ON bags.item_id = target_id WHERE category = drift_to)"""


def _case_sql(*more: str, select: str) -> str:
    return sql.query(sql.EVENTS, sql.SPLIT, sql.CASES, sql.ALL_TRANSITIONS, _CASE, *more, select=select)


@register("evidence_rows", _case_sql(select="SELECT case_id, evidence_type, source_id, target_id, transition_count, round(window_score, 6) AS window_score, round(similarity, 6) AS similarity, round(recent_signal, 6) AS recent_signal, round(mean_gap, 6) AS mean_gap, gap_bucket, drift_from, drift_to FROM ev"))
def _(spark, folder):
    return rounded(_evidence(spark, folder).drop("evidence_id"))


@register("evidence_types", _case_sql(select="SELECT evidence_type, count(*) AS rows, count(DISTINCT case_id) AS cases FROM ev GROUP BY 1"))
def _(spark, folder):
    return _evidence(spark, folder).groupBy("evidence_type").agg(F.count("*").alias("rows"), F.count_distinct("case_id").alias("cases"))


@register("evidence_weighted_scores", _case_sql(select="SELECT case_id, target_id, round(sum(coalesce(transition_count, 0) + 0.5::DOUBLE * coalesce(window_score, 0) + 0.3::DOUBLE * coalesce(similarity, 0) + 0.2::DOUBLE * coalesce(recent_signal, 0)), 6) AS score FROM ev GROUP BY ALL"))
def _(spark, folder):
    return rounded(evidence.weighted_score(_evidence(spark, folder)))


@register("evidence_ids", _case_sql(select="SELECT DISTINCT evidence_type, source_id, target_id, 'ev_' || substr(sha1(concat_ws('|', evidence_type, source_id, target_id)), 1, 16) AS evidence_id FROM ev"))
def _(spark, folder):
    return _evidence(spark, folder).select("evidence_type", "source_id", "target_id", "evidence_id").distinct()


_TEXT = """CASE evidence_type
      WHEN 'transition' THEN concat_ws('; ', 'After item ' || source_id || ', users reached item ' || target_id, 'transition_count=' || transition_count, 'mean_gap_seconds=' || printf('%.4g', mean_gap), 'gap_bucket=' || gap_bucket) || '.'
      WHEN 'time_window' THEN concat_ws('; ', 'item ' || source_id || ' and item ' || target_id || ' appeared in the configured time window', 'time_window_score=' || printf('%.4g', window_score), 'gap_bucket=' || gap_bucket) || '.'
      WHEN 'contrastive' THEN concat_ws('; ', 'item ' || target_id || ' is contrasted with item ' || source_id, 'semantic_similarity=' || printf('%.4g', similarity), CASE WHEN transition_count > 0 THEN 'transition_count=' || transition_count END, 'gap_bucket=' || gap_bucket) || '.'
      WHEN 'semantic' THEN concat_ws('; ', 'item ' || source_id || ' and item ' || target_id || ' share item metadata evidence', 'semantic_similarity=' || printf('%.4g', similarity)) || '.'
      WHEN 'history' THEN concat_ws('; ', 'item ' || source_id || ' is in the user''s history before considering item ' || target_id, 'recent_signal=' || printf('%.4g', recent_signal)) || '.'
      ELSE concat_ws('; ', 'History category drift supports checking item ' || target_id, 'drift_from=' || drift_from, 'drift_to=' || drift_to) || '.' END"""


@register("evidence_text", _case_sql(select=f"SELECT case_id, evidence_type, source_id, target_id, {_TEXT} AS text FROM ev"))
def _(spark, folder):
    return evidence.translate(_evidence(spark, folder)).select("case_id", "evidence_type", "source_id", "target_id", "text")


@register(
    "evidence_top_text",
    _case_sql(
        "ids AS (SELECT DISTINCT *, 'ev_' || substr(sha1(concat_ws('|', evidence_type, source_id, target_id)), 1, 16) AS evidence_id FROM ev)",
        "rk AS (SELECT *, row_number() OVER (PARTITION BY case_id, target_id ORDER BY list_position(['transition', 'time_window', 'contrastive', 'semantic', 'history', 'user_drift'], evidence_type), coalesce(transition_count::DOUBLE, window_score, similarity, recent_signal, 0) DESC, evidence_id) AS rank FROM ids)",
        select=f"SELECT case_id, target_id, rank, evidence_id, {_TEXT} AS text FROM rk WHERE rank <= 3",
    ),
)
def _(spark, folder):
    return evidence.translate(evidence.first_of_each(_evidence(spark, folder), 3)).select("case_id", "target_id", "rank", "evidence_id", "text")


@register(
    "evidence_grounding",
    _case_sql("a AS (SELECT case_id, evidence_type, source_id, target_id, gap_bucket, target_id % 2 = 0 AS good FROM ev WHERE evidence_type = 'transition')", select="SELECT count(*) AS used, round(avg(CASE WHEN good THEN 1.0 ELSE 0 END), 6) AS grounding_rate, round(avg(CASE WHEN good AND gap_bucket = 'same_day' THEN 1.0 ELSE 0 END), 6) AS bucket_rate FROM a"),
)
def _(spark, folder):
    sources, candidates, edges, _ = _inputs(spark, folder)
    given = evidence.transition_evidence(evidence.probe(sources, candidates), edges)
    answers = given.select("case_id", F.when(F.col("target_id") % 2 == 0, F.col("evidence_id")).otherwise("ev_unknown").alias("evidence_id"), F.lit("same_day").alias("mentions_bucket"))
    return rounded(evidence.grounding(answers, given))


@register(
    "leakage_violations",
    sql.query(sql.EVENTS, sql.SPLIT, select="SELECT t.event_id, 'target_in_history' AS violation FROM loo t WHERE t.split = 'test' AND EXISTS (SELECT 1 FROM loo h WHERE h.user_id = t.user_id AND h.split = 'train' AND h.item_id = t.item_id)"),
)
def _(spark, folder):
    past = sequences.histories(train_events(spark, folder)).select("user_id", F.col("items").alias("history"))
    rows = test_cases(spark, folder).join(past, "user_id").select("event_id", "history", F.col("item_id").alias("target_id"), F.col("ts").alias("case_ts"), (F.col("ts") - 1).alias("evidence_ts"), F.lit("train_only").alias("provenance"))
    return evidence.leaks(rows).select("event_id", "violation")


_STEPS = """st AS (SELECT user_id, item_id, row_number() OVER w - 1 AS place, ts - lag(ts) OVER w AS gap, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM loo WHERE split = 'train' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
l5 AS (SELECT user_id, 'item ' || item_id AS title, 5 - back AS place, gap, CASE WHEN gap IS NULL THEN 'unknown' WHEN gap <= 3600 THEN 'same_session' WHEN gap <= 86400 THEN 'same_day' WHEN gap <= 604800 THEN 'same_week' WHEN gap <= 2592000 THEN 'same_month' ELSE 'old' END AS bucket FROM st WHERE back <= 5)"""


def _steps(spark, folder):
    train = train_events(spark, folder)
    gaps = train.withColumn("gap", F.col("ts") - F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    back = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    last = gaps.withColumn("back", back).where("back <= 5")
    return last.select(F.col("user_id").alias("case_id"), (5 - F.col("back")).alias("place"), F.concat(F.lit("item "), F.col("item_id")).alias("title"), "gap", sequences.time_bucket(F.col("gap")).alias("bucket"))


@register("prompt_bucket_chain", sql.query(sql.EVENTS, sql.SPLIT, _STEPS, select="SELECT user_id AS case_id, string_agg('[' || bucket || '] ' || title, '; ' ORDER BY place) AS history_line FROM l5 GROUP BY 1"))
def _(spark, folder):
    return prompts.chain(_steps(spark, folder), "with_time_buckets")


_GAP = "CASE WHEN gap IS NULL THEN 'unknown gap' WHEN gap < 3600 THEN printf('%.0f seconds', gap::DOUBLE) WHEN gap < 86400 THEN printf('%.1f hours', gap / 3600) ELSE printf('%.1f days', gap / 86400) END"


@register("prompt_gap_chain", sql.query(sql.EVENTS, sql.SPLIT, _STEPS, select=f"SELECT user_id AS case_id, string_agg(CASE WHEN place = 0 THEN title ELSE 'after ' || {_GAP} || ' -> ' || title END, '; ' ORDER BY place) AS history_line FROM l5 GROUP BY 1"))
def _(spark, folder):
    return prompts.chain(_steps(spark, folder), "with_time_gaps")


@register(
    "prompts",
    sql.query(sql.EVENTS, sql.SPLIT, _STEPS, "h AS (SELECT user_id, string_agg(title, '; ' ORDER BY place) AS line FROM l5 GROUP BY 1)", select="SELECT user_id AS case_id, 'Rank the candidates for the user''s next item. Answer with JSON.' || chr(10) || 'History: ' || line || chr(10) || 'Candidates: item 1, item 2' AS prompt, 'history_only' AS variant FROM h"),
)
def _(spark, folder):
    lines = prompts.chain(_steps(spark, folder), "history_only").withColumn("candidate_line", F.lit("item 1, item 2")).withColumn("evidence_line", F.lit(""))
    return prompts.build(lines, "history_only").select("case_id", "prompt", "variant")


def _answers(spark, folder, kind):
    items = event_interactions(spark, folder).groupBy("user_id").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("candidates"))
    return items.withColumn("response", prompts.mock_answer(kind, F.col("candidates")))


_CANDS = "c AS (SELECT user_id, list(DISTINCT item_id::VARCHAR ORDER BY item_id::VARCHAR) AS l FROM ia GROUP BY 1)"


@register("parsed_answers", sql.query(sql.EVENTS, _CANDS, select="SELECT user_id, true AS parse_success, array_to_string(list_reverse(l), ',') AS ranked, 0 AS invalid FROM c"))
def _(spark, folder):
    return prompts.parse(_answers(spark, folder, "reverse")).select("user_id", "parse_success", F.array_join("ranked", ",").alias("ranked"), F.size("invalid").alias("invalid"))


@register("hallucinated_answers", sql.query(sql.EVENTS, _CANDS, select="SELECT user_id, array_to_string(l, ',') AS ranked, 'made_up_item' AS invalid FROM c"))
def _(spark, folder):
    found = prompts.parse(_answers(spark, folder, "hallucinating"))
    return found.select("user_id", F.array_join(prompts.complete(F.col("ranked"), F.col("candidates")), ",").alias("ranked"), F.array_join("invalid", ",").alias("invalid"))


_TOKENS = "CASE WHEN text IS NULL OR text = '' THEN 0 ELSE greatest(CAST(ceil(len(text) / 4) AS BIGINT), len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')), 1) END"


@register("token_estimates", f"SELECT conv_id, turn, {_TOKENS} AS tokens FROM conversations")
def _(spark, folder):
    return table(spark, folder, "conversations").select("conv_id", "turn", prompts.token_estimate(F.col("text")).alias("tokens"))


_REQ = f"""r AS (SELECT role, turn, CASE WHEN role = 'user' THEN {_TOKENS} ELSE 0 END AS p, CASE WHEN role = 'user' THEN 0 ELSE {_TOKENS} END AS c, conv_id % 3 = 0 AS hit, len(text)::DOUBLE AS ms FROM conversations)"""


@register(
    "cost_summary",
    sql.query(_REQ, select="""SELECT role, count(*) AS requests, sum(p + c)::BIGINT AS total_tokens, round(sum(p / 1e6 * CASE WHEN hit THEN 0.028::DOUBLE ELSE 0.14::DOUBLE END + c / 1e6 * 0.28::DOUBLE), 6) AS estimated_cost, round(avg(ms), 6) AS latency_mean, quantile_disc(ms, 0.5) AS latency_p50,
      quantile_disc(ms, 0.95) AS latency_p95, round(avg(hit::INT), 6) AS cache_hit_rate, round(count(*) * 60 / (sum(ms) / 1000), 6) AS requests_per_minute FROM r GROUP BY role"""),
)
def _(spark, folder):
    tokens, user = prompts.token_estimate(F.col("text")), F.col("role") == "user"
    rows = table(spark, folder, "conversations").select("role", F.when(user, tokens).otherwise(0).alias("prompt_tokens"), F.when(user, 0).otherwise(tokens).alias("completion_tokens"), (F.col("conv_id") % 3 == 0).alias("cache_hit"), F.length("text").cast("double").alias("latency_ms"))
    priced = rows.withColumn("cost", prompts.request_cost(F.col("prompt_tokens"), F.col("completion_tokens"), F.col("cache_hit"), 0.028, 0.14, 0.28))
    return rounded(prompts.cost_summary(priced, ["role"]))


@register("cache_misses", "SELECT conv_id, turn, sha256(role || chr(31) || text) AS cache_key FROM conversations WHERE sha256(role || chr(31) || text) NOT IN (SELECT sha256(role || chr(31) || text) FROM conversations WHERE conv_id % 2 = 0)")
def _(spark, folder):
    rows = table(spark, folder, "conversations").withColumn("cache_key", prompts.cache_key("role", "text"))
    return prompts.uncached(rows, rows.where("conv_id % 2 = 0")).select("conv_id", "turn", "cache_key")


def _factors(spark, folder):
    pairs = models.positive_pairs(train_events(spark, folder)).select(F.col("user_id").alias("user"), F.col("item_id").alias("item"))
    trials = [{"factors": f, "epochs": 1, "rate": 0.05, "decay": 0.002, "seed": 0} for f in (8, 16)]
    return pairs, models.sweep(pairs, trials)


@register("bpr_sweep")
def _(spark, folder):
    pairs, factors = _factors(spark, folder)
    cases = factors.where("kind = 'user'").select("trial", F.col("id").alias("user"))
    return models.top_unseen(factors, cases, pairs, 5).withColumnRenamed("item", "item_id")


@register("bpr_full_ranking")
def _(spark, folder):
    _, factors = _factors(spark, folder)
    tested = test_cases(spark, folder).select(F.col("event_id").alias("case_id"), F.col("user_id").alias("user"), F.col("item_id").alias("item"))
    seen = split_events(spark, folder).where("split <> 'test'").select(F.col("user_id").alias("user"), F.col("item_id").alias("item"))
    ranks = models.target_ranks(factors, tested.crossJoin(F.broadcast(factors.select("trial").distinct())), seen)
    return rounded(metrics.ranking(ranks, (5, 10), ["trial"]).where("trial is not null"))


def _drained(spark, name, frame):
    """Run a stream to the end of its input into Parquet files of the shared folder, and read these."""
    place = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    query = frame.writeStream.outputMode("append").format("parquet").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{place}/rows")


def _event_stream(spark, folder):
    static = spark.read.parquet(f"{folder}/events.parquet")
    raw = spark.readStream.schema(static.schema).format("parquet").load(f"{folder}/events.parquet*")
    seconds = F.expr("cast(cast(ts - timestamp_ntz'1970-01-01 00:00:00' as interval second) as bigint)")
    return raw.select("event_id", "user_id", F.get_json_object("props", "$.k").cast("long").alias("item_id"), seconds.alias("ts"), F.timestamp_seconds(seconds).alias("event_time"))


_STRICT = """s AS (SELECT *, count(*) OVER (PARTITION BY user_id, ts) AS n FROM ia)"""


@register(
    "stream_transitions",
    sql.query(sql.EVENTS, _STRICT, select="""SELECT user_id, source_id, target_id, source_ts, target_ts, target_ts - source_ts AS gap FROM (
      SELECT user_id, lag(item_id) OVER w AS source_id, item_id AS target_id, lag(ts) OVER w AS source_ts, ts AS target_ts, lag(n) OVER w AS b FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
      WHERE source_ts < target_ts AND b = 1"""),
)
def _(spark, folder):
    return _drained(spark, "transitions", streams.stream_transitions(_event_stream(spark, folder).select("user_id", "item_id", "ts", "event_id")))


_CLOSED = "w AS (SELECT max(ts) - 3600 AS mark FROM ia)"


@register(
    "stream_ordered_transitions",
    sql.query(sql.EVENTS, _STRICT, _CLOSED, select="""SELECT user_id, source_id, target_id, source_ts, target_ts, target_ts - source_ts AS gap FROM (
      SELECT user_id, lag(item_id) OVER w AS source_id, item_id AS target_id, lag(ts) OVER w AS source_ts, ts AS target_ts, lag(n) OVER w AS b FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
      WHERE source_ts < target_ts AND b = 1 AND target_ts < (SELECT mark FROM w)"""),
)
def _(spark, folder):
    """What the watermark has passed at the end of the input."""
    return _drained(spark, "ordered", streams.ordered_transitions(_event_stream(spark, folder).select("user_id", "item_id", "ts", "event_id"), "1 hour"))



@register("stream_popularity", sql.query(sql.EVENTS, _CLOSED, select="SELECT ts // 86400 AS day, item_id, count(*) AS count FROM ia WHERE (ts // 86400 + 1) * 86400 <= (SELECT mark FROM w) GROUP BY ALL"))
def _(spark, folder):
    """The days that the watermark has closed at the end of the input."""
    counted = _drained(spark, "popularity", streams.stream_popularity(_event_stream(spark, folder).select("event_time", "item_id"), length="1 day"))
    return counted.select(F.expr("unix_seconds(window_start) div 86400").alias("day"), "item_id", "count")


@register(
    "stream_sessions",
    sql.query(
        sql.EVENTS,
        _CLOSED,
        "m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= 1800 THEN 1 ELSE 0 END AS n FROM ia)",
        "s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM m)",
        select="SELECT user_id, min(ts) AS first_ts, max(ts) + 1800 AS end_ts, count(*) AS events FROM s GROUP BY user_id, s HAVING max(ts) + 1800 <= (SELECT mark FROM w)",
    ),
)
def _(spark, folder):
    """The sessions that the watermark has closed at the end of the input."""
    found = _drained(spark, "sessions", streams.stream_sessions(_event_stream(spark, folder).select("event_time", "user_id")))
    return found.select("user_id", F.expr("unix_seconds(session_start)").alias("first_ts"), F.expr("unix_seconds(session_end)").alias("end_ts"), "events")
