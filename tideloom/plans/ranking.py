"""Queries: rankers, candidates, text overlap and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideloom.functions.cuts import cut
from tideloom.functions.text import item_tokens
from tideloom.operators import asof, graph, metrics, rank, semantic, sequences, stats
from tideloom.plans import sql
from tideloom.plans.base import catalogue, rounded, split_events, test_cases, train_edges, train_events
from tideloom.plans.registry import register
from tideloom.sources.tables import event_interactions, part_items, table

_BM25 = """t AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents) GROUP BY ALL),
l AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS length FROM documents),
c AS (SELECT count(*) AS n, avg(length) AS mean FROM l),
d AS (SELECT token, count(*) AS df FROM t GROUP BY 1),
q AS (SELECT item_id AS query_id, token, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM benchmark) GROUP BY ALL),
s AS (SELECT query_id, doc_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))) AS score
  FROM q JOIN d USING (token) CROSS JOIN c JOIN t USING (token) JOIN l USING (doc_id) GROUP BY ALL)"""


@register("bm25_topk", sql.query(_BM25, select="SELECT query_id, doc_id AS item_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s QUALIFY rank <= 10"))
def _(spark, folder):
    queries = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return rank.bm25_top_k(queries, table(spark, folder, "documents"), 10).withColumnRenamed("doc_id", "item_id")


_POP = "pop AS (SELECT item_id, count(*) AS n FROM loo WHERE split = 'train' GROUP BY 1)"


@register("popularity_topk", sql.query(sql.EVENTS, sql.SPLIT, _POP, select="SELECT item_id, n::DOUBLE AS score, row_number() OVER (ORDER BY n DESC, item_id) AS rank FROM pop QUALIFY rank <= 20"))
def _(spark, folder):
    best = rank.popularity(train_events(spark, folder)).orderBy(F.desc("score"), "item_id").limit(20)
    return rank.top_k(best.withColumn("all", F.lit(1)), ["all"], 20).drop("all")


_LAST = "last AS (SELECT user_id, item_id AS source_id FROM loo WHERE split = 'val')"


@register(
    "markov_rank",
    sql.query(sql.EVENTS, sql.SPLIT, sql.ALL_TRANSITIONS, _POP, _LAST, select="SELECT u.user_id, p.item_id, round(coalesce(m.count, 0) + 1e-6 * coalesce(p.n, 0), 9) AS score, row_number() OVER (PARTITION BY u.user_id ORDER BY round(coalesce(m.count, 0) + 1e-6 * coalesce(p.n, 0), 9) DESC, p.item_id) AS rank FROM last u CROSS JOIN pop p LEFT JOIN moves m ON m.source_id = u.source_id AND m.target_id = p.item_id QUALIFY rank <= 10"),
)
def _(spark, folder):
    train = train_events(spark, folder)
    last = split_events(spark, folder).where("split = 'val'").select("user_id", "item_id")
    return rank.markov_top_k(last, graph.transition_edges(train), rank.popularity(train), 10)


@register(
    "random_rank",
    sql.query(sql.EVENTS, sql.SPLIT, _POP, select="SELECT user_id, p.item_id, ('0x' || substr(sha256('0|' || user_id || '|' || p.item_id), 1, 16))::UBIGINT / 18446744073709551616.0::DOUBLE AS score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, p.item_id) AS rank FROM (SELECT DISTINCT user_id FROM loo) CROSS JOIN pop p QUALIFY rank <= 5"),
)
def _(spark, folder):
    events = split_events(spark, folder)
    return rank.random_top_k(events, train_events(spark, folder), 5)


_RECENT = "recent AS (SELECT user_id, item_id AS source_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS p FROM loo WHERE split = 'train')"


@register(
    "transition_retriever",
    sql.query(sql.EVENTS, sql.SPLIT, sql.ALL_TRANSITIONS, _RECENT, "s AS (SELECT user_id, target_id AS item_id, sum(count)::DOUBLE AS score FROM recent JOIN moves USING (source_id) WHERE p <= 5 GROUP BY ALL)", select="SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM s WHERE NOT EXISTS (SELECT 1 FROM loo l WHERE l.split = 'train' AND l.user_id = s.user_id AND l.item_id = s.item_id) QUALIFY rank <= 10"),
)
def _(spark, folder):
    train = train_events(spark, folder)
    return rank.top_k(rank.transition_retriever(sequences.histories(train), graph.transition_edges(train)), ["user_id"], 10)


@register(
    "evidence_scores",
    sql.query(
        sql.EVENTS,
        sql.SPLIT,
        sql.ALL_TRANSITIONS,
        _RECENT,
        "cand AS (SELECT DISTINCT l.user_id, p.item_id FROM loo l CROSS JOIN (SELECT DISTINCT item_id FROM loo WHERE split = 'train') p)",
        "r3 AS (SELECT * FROM recent WHERE p <= 3)",
        "base AS (SELECT c.user_id, c.item_id, sum(coalesce(m.count, 0) + CASE WHEN r.source_id <> c.item_id THEN 0.05::DOUBLE / r.p ELSE 0 END) AS base FROM cand c JOIN r3 r USING (user_id) LEFT JOIN moves m ON m.source_id = r.source_id AND m.target_id = c.item_id GROUP BY ALL)",
        "kinds AS (SELECT user_id, p_type, count(*) AS n, min(p) AS p FROM r3 JOIN part ON p_partkey = source_id GROUP BY user_id, p_type)",
        "liked AS (SELECT user_id, p_type AS liked FROM kinds QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, p) = 1)",
        select="SELECT user_id, item_id, round(base + CASE WHEN p_type = liked THEN 0.1 ELSE 0 END, 6) AS score FROM base LEFT JOIN liked USING (user_id) LEFT JOIN part ON p_partkey = item_id",
    ),
)
def _(spark, folder):
    train = train_events(spark, folder)
    pairs = split_events(spark, folder).select("user_id").distinct().crossJoin(train.select("item_id").distinct())
    return rounded(rank.evidence_scores(pairs, sequences.histories(train), graph.transition_edges(train), part_items(spark, folder)))


_HASH = "('0x' || substr(sha256('0|' || user_id || '|' || item_id), {}, 12))::BIGINT"
_RING = "ring AS (SELECT item_id, row_number() OVER (ORDER BY sha256('0|' || item_id), item_id) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT item_id FROM ia))"
_PRIME = "pr AS (SELECT n, (SELECT min(x) FROM range(greatest(n, 2), 2 * n + 3) t(x) WHERE NOT EXISTS (SELECT 1 FROM range(2, 1000) s(d) WHERE d * d <= x AND x % d = 0)) AS p FROM (SELECT max(n) AS n FROM ring))"


@register(
    "sampled_candidates",
    sql.query(
        sql.EVENTS,
        sql.SPLIT,
        sql.CASES,
        _RING,
        _PRIME,
        f"d AS (SELECT event_id, item_id AS target, 1 + {_HASH.format(1)} % (p - 1) AS a, {_HASH.format(13)} % p AS b, p, unnest(range(least(p, least(20, n) + p - n))) AS i FROM cases CROSS JOIN pr)",
        "o AS (SELECT d.event_id, r.item_id, row_number() OVER (PARTITION BY d.event_id ORDER BY i) AS k FROM d JOIN ring r ON r.place = (a * i + b) % p WHERE r.item_id <> target)",
        select="SELECT event_id, item_id FROM o WHERE k < (SELECT least(20, n) FROM pr) UNION ALL SELECT event_id, item_id FROM cases",
    ),
)
def _(spark, folder):
    return rank.sampled_candidates(test_cases(spark, folder), event_interactions(spark, folder), 20)


@register(
    "pool_candidates",
    sql.query(sql.EVENTS, sql.SPLIT, sql.CASES, _RING, "p AS (SELECT item_id, place FROM ring WHERE place < 20)", select="SELECT c.event_id, p.item_id FROM cases c CROSS JOIN p WHERE c.item_id IN (SELECT item_id FROM p) OR p.place < 19 UNION ALL SELECT event_id, item_id FROM cases WHERE item_id NOT IN (SELECT item_id FROM p)"),
)
def _(spark, folder):
    return rank.resolve_pool(test_cases(spark, folder), rank.pool(event_interactions(spark, folder), 20), 20)


@register("candidate_row_ids", sql.query(sql.EVENTS, sql.SPLIT, sql.CASES, select="SELECT event_id, split || '|' || user_id || '|' || item_id AS row_id FROM cases"))
def _(spark, folder):
    return test_cases(spark, folder).select("event_id", rank.row_id(F.col("split"), F.col("user_id"), F.col("item_id")).alias("row_id"))


_DOT = "SELECT q.vec_id AS query_id, v.vec_id AS item_id, round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)), 6) AS score FROM embeddings q CROSS JOIN embeddings v WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id"


@register("dot_product_topk", f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM ({_DOT}) QUALIFY rank <= 5")
def _(spark, folder):
    vectors = table(spark, folder, "embeddings")
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    items = vectors.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    return rank.dot_top_k(queries, items, 5)


_STOP = "('a', 'an', 'and', 'by', 'for', 'from', 'in', 'item', 'movie', 'of', 'on', 'or', 'the', 'to', 'with')"
_INDEX = f"""idx AS (SELECT DISTINCT item_id, token FROM (
  SELECT p_partkey AS item_id, unnest(regexp_extract_all(lower(concat_ws(' ', p_name, p_brand)), '[a-z0-9]+')) AS token FROM part WHERE p_partkey IN (SELECT item_id FROM ia))
  WHERE len(token) >= 2 AND regexp_matches(token, '[a-z]') AND token NOT IN {_STOP})"""
_OVERLAP = """sz AS (SELECT item_id, count(*) AS n FROM idx GROUP BY 1),
ov AS (SELECT a.item_id, b.item_id AS other_id, count(*) AS shared, count(*) / (any_value(x.n) + any_value(y.n) - count(*)) AS jaccard FROM idx a JOIN idx b ON a.token = b.token AND a.item_id <> b.item_id JOIN sz x ON x.item_id = a.item_id JOIN sz y ON y.item_id = b.item_id GROUP BY a.item_id, b.item_id)"""


def _index(spark, folder):
    return semantic.token_index(catalogue(spark, folder), ["title", "brand"])


@register("item_tokens", sql.query(sql.EVENTS, _INDEX, select="SELECT * FROM idx"))
def _(spark, folder):
    return _index(spark, folder)


@register("token_overlap_pairs", sql.query(sql.EVENTS, _INDEX, _OVERLAP, select="SELECT item_id, other_id, shared, round(jaccard, 6) AS jaccard FROM ov"))
def _(spark, folder):
    return rounded(semantic.overlap_pairs(_index(spark, folder)))


_AGAINST = """ag AS (SELECT coalesce(o.item_id, e.source_id) AS source_id, coalesce(o.other_id, e.target_id) AS target_id, coalesce(o.jaccard, 0) AS similarity, coalesce(e.support, 0) AS transition_count
  FROM ov o FULL JOIN (SELECT * FROM edges WHERE source_id <> target_id) e ON e.source_id = o.item_id AND e.target_id = o.other_id)"""


@register(
    "similarity_vs_transition",
    sql.query(sql.EVENTS, sql.SPLIT, sql.TRAIN_PAIRS, sql.EDGES, _INDEX, _OVERLAP, _AGAINST, select="""SELECT source_id, target_id, round(similarity, 6) AS similarity, transition_count,
      CASE WHEN similarity >= 0.5 AND transition_count > 0 THEN 'semantic_and_transition' WHEN similarity >= 0.5 THEN 'semantic_only' WHEN transition_count > 0 THEN 'transition_only' ELSE 'neither' END AS case_group,
      CASE WHEN transition_count > 0 THEN CASE WHEN a.p_type = b.p_type THEN 'same_category_transition' ELSE 'cross_category_transition' END END AS category_group
      FROM ag LEFT JOIN part a ON a.p_partkey = source_id LEFT JOIN part b ON b.p_partkey = target_id"""),
)
def _(spark, folder):
    items = catalogue(spark, folder)
    return rounded(semantic.against_transitions(semantic.overlap_pairs(_index(spark, folder)), train_edges(spark, folder), items.select("item_id", "category")))


@register(
    "semantic_case_labels",
    sql.query(
        sql.EVENTS,
        sql.SPLIT,
        sql.CASES,
        sql.RETRIEVAL,
        _INDEX,
        "m AS (SELECT s.event_id, s.source_id, s.recency, count(*) AS shared FROM sources s JOIN idx a ON a.item_id = s.source_id JOIN cases c ON c.event_id = s.event_id JOIN idx b ON b.item_id = c.item_id AND b.token = a.token GROUP BY ALL)",
        "mx AS (SELECT event_id, max(shared) AS shared FROM m GROUP BY 1)",
        "st AS (SELECT DISTINCT event_id FROM sources WHERE source_id IN (SELECT item_id FROM idx))",
        "j AS (SELECT r.event_id, r.item_id, r.rank, coalesce(mx.shared, 0) AS shared, NOT EXISTS (SELECT 1 FROM sources s WHERE s.event_id = r.event_id) OR (r.item_id IN (SELECT item_id FROM idx) AND r.event_id NOT IN (SELECT event_id FROM st)) AS absent FROM ranks r LEFT JOIN mx USING (event_id))",
        select="SELECT event_id, item_id, CASE WHEN NOT absent THEN shared END AS overlap_max, CASE WHEN absent THEN 'not_computed' WHEN shared > 0 AND rank IS NOT NULL THEN 'semantic_and_transition' WHEN shared > 0 THEN 'semantic_only' WHEN rank IS NOT NULL THEN 'transition_only' ELSE 'neither_semantic_nor_transition' END AS case_type FROM j",
    ),
)
def _(spark, folder):
    cases, events = test_cases(spark, folder), split_events(spark, folder)
    sources = asof.sources_of(cases, events.where("split <> 'test'"), 20)
    ranks = asof.target_ranks(cases, asof.retrieve(cases, events))
    return semantic.case_labels(cases, sources, _index(spark, folder), ranks)


_NEG_SQL = """mine AS (SELECT * FROM loo WHERE split <> 'test'),
seen AS (SELECT DISTINCT c.event_id, m.item_id FROM cases c JOIN mine m ON m.user_id = c.user_id AND m.ts < c.ts),
el AS (SELECT c.event_id, p.item_id FROM cases c CROSS JOIN (SELECT DISTINCT item_id FROM ia) p WHERE p.item_id <> c.item_id AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.event_id = c.event_id AND s.item_id = p.item_id)),
prev AS (SELECT event_id, item_id AS source_id FROM (SELECT c.event_id, m.item_id, row_number() OVER (PARTITION BY c.event_id ORDER BY m.ts DESC, m.event_id DESC) AS r FROM cases c JOIN mine m ON m.user_id = c.user_id AND m.ts < c.ts) WHERE r = 1),
rows AS (SELECT el.event_id, el.item_id, coalesce(ov.shared, 0) AS overlap, coalesce(e.p, 0) AS score, coalesce(e.support, 0) AS support, coalesce(pop.n, 0) AS popularity,
  ('0x' || substr(sha256('0|' || el.event_id || '|' || el.item_id), 1, 12))::BIGINT AS key
  FROM el JOIN prev USING (event_id) LEFT JOIN ov ON ov.item_id = prev.source_id AND ov.other_id = el.item_id
  LEFT JOIN (SELECT source_id, target_id, support, support / sum(support) OVER (PARTITION BY source_id) AS p FROM edges) e ON e.source_id = prev.source_id AND e.target_id = el.item_id
  LEFT JOIN pop ON pop.item_id = el.item_id)"""


def _stress_inputs(spark, folder):
    """(cases, events before them, training events, each case's last item, edges, overlaps of the last items), cut, since negatives and their measures read each several times."""
    events = cut(split_events(spark, folder))
    cases, mine, train = events.where("split = 'test'"), events.where("split <> 'test'"), events.where("split = 'train'")
    previous = cut(asof.sources_of(cases, mine, 1).select("event_id", "source_id"))
    edges = cut(graph.tdig_edges(graph.transitions(train)).select("source_id", F.col("target_id").alias("item_id"), "transition_probability", "support"))
    close = semantic.overlap_pairs(_index(spark, folder), previous.select(F.col("source_id").alias("item_id")))
    return cases, mine, train, previous, edges, cut(close.select(F.col("item_id").alias("source_id"), F.col("other_id").alias("item_id"), "shared"))


def _negatives(spark, folder, inputs):
    cases, mine, train, previous, edges, close = inputs
    asked = cases.join(previous.select("event_id"), "event_id", "left_semi")
    near = previous.join(close, "source_id").select("event_id", "item_id", F.col("shared").alias("overlap"))
    moves = previous.join(edges, "source_id").select("event_id", "item_id", F.col("transition_probability").alias("score"), "support")
    counts = rank.popularity(train).select("item_id", F.col("score").cast("long").alias("popularity"))
    seen = asof.seen_before(cases, mine).join(asked, "event_id", "left_semi")
    return semantic.hard_negatives(asked, event_interactions(spark, folder), seen, near, moves, counts)


@register(
    "hard_negatives",
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
        select="""SELECT event_id, first(item_id ORDER BY overlap DESC, support > 0, score, popularity DESC, item_id) FILTER (overlap > 0) AS semantic_negative,
      first(item_id ORDER BY score DESC, overlap, support DESC, item_id) FILTER (score > 0) AS transition_negative, first(item_id ORDER BY popularity DESC, item_id) FILTER (popularity > 0) AS popularity_negative,
      first(item_id ORDER BY key, item_id) AS random_negative FROM rows GROUP BY event_id""",
    ),
)
def _(spark, folder):
    return _negatives(spark, folder, _stress_inputs(spark, folder))


_SEG_SQL = """seg AS (SELECT r.*, CASE WHEN h.n < 5 THEN '1-4' WHEN h.n < 20 THEN '5-19' WHEN h.n < 100 THEN '20-99' ELSE '100+' END AS history,
  CASE WHEN r.ts - h.last <= 86400 THEN '<=1d' WHEN r.ts - h.last <= 604800 THEN '<=7d' WHEN r.ts - h.last <= 2592000 THEN '<=30d' ELSE '>30d' END AS gap
  FROM ranks r JOIN (SELECT user_id, count(*) AS n, max(ts) AS last FROM mine GROUP BY 1) h USING (user_id))"""


def _segmented(spark, folder):
    cases, events = test_cases(spark, folder), split_events(spark, folder)
    ranks = asof.target_ranks(cases, asof.retrieve(cases, events))
    past = events.where("split <> 'test'").groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return ranks.join(past, "user_id").withColumn("history", metrics.history_bucket(F.col("n"))).withColumn("gap", metrics.gap_segment(F.col("ts") - F.col("last")))


@register("segment_metrics", sql.query(sql.EVENTS, sql.SPLIT, sql.CASES, sql.RETRIEVAL, _SEG_SQL, select=f"SELECT history, gap, {sql.ranking_columns((5, 10))} FROM seg GROUP BY GROUPING SETS ((), (history), (gap))"))
def _(spark, folder):
    return rounded(metrics.ranking(_segmented(spark, folder), (5, 10), ["history", "gap"]))


_PRED = "pred AS (SELECT event_id, candidate_id AS item_id, score, rank FROM retrieved WHERE rank <= 10)"


def _predictions(spark, folder):
    return asof.retrieve(test_cases(spark, folder), split_events(spark, folder)).where("rank <= 10").select("event_id", F.col("candidate_id").alias("item_id"), "score", "rank")


def _pred_sql(*more: str, select: str) -> str:
    return sql.query(sql.EVENTS, sql.SPLIT, sql.CASES, sql.RETRIEVAL, _PRED, *more, select=select)


@register("catalogue_coverage", _pred_sql(select="SELECT (SELECT count(DISTINCT item_id) FROM pred WHERE item_id IN (SELECT p_partkey FROM part)) AS predicted, count(*) AS items, round((SELECT count(DISTINCT item_id) FROM pred WHERE item_id IN (SELECT p_partkey FROM part)) / count(*), 6) AS coverage FROM part"))
def _(spark, folder):
    return rounded(metrics.catalogue_coverage(_predictions(spark, folder), part_items(spark, folder), 10))


@register("novelty", _pred_sql(_POP, select="SELECT round(avg(-log2((coalesce(n, 0) + 1) / ((SELECT sum(n) FROM pop) + (SELECT count(*) FROM pop) + 1))), 6) AS novelty, count(*) AS predictions FROM pred LEFT JOIN pop USING (item_id)"))
def _(spark, folder):
    return rounded(metrics.novelty(_predictions(spark, folder), train_events(spark, folder)))


@register(
    "long_tail",
    _pred_sql(_POP, sql.TAIL, select="SELECT count(*) AS predictions, count(*) FILTER (item_id IN (SELECT item_id FROM tail)) AS in_tail, round(count(*) FILTER (item_id IN (SELECT item_id FROM tail)) / count(*), 6) AS long_tail_ratio FROM pred"),
)
def _(spark, folder):
    return rounded(metrics.long_tail(_predictions(spark, folder), train_events(spark, folder)))


@register("popularity_buckets", _pred_sql(_POP, "b AS (SELECT CASE WHEN n IS NULL THEN 'unseen' WHEN n <= 1 THEN 'tail' WHEN n <= 5 THEN 'mid' ELSE 'head' END AS bucket FROM pred LEFT JOIN pop USING (item_id))", select="SELECT bucket, count(*) AS n, round(count(*) / (SELECT count(*) FROM b), 6) AS share FROM b GROUP BY bucket"))
def _(spark, folder):
    return rounded(metrics.bucket_shares(_predictions(spark, folder), train_events(spark, folder)))


@register(
    "list_diversity",
    _pred_sql(
        _INDEX,
        _OVERLAP,
        select="SELECT a.event_id, round(coalesce(avg(1 - coalesce(o.jaccard, 0)) FILTER (b.item_id IS NOT NULL), 0), 6) AS diversity FROM pred a LEFT JOIN pred b ON a.event_id = b.event_id AND a.rank < b.rank LEFT JOIN ov o ON o.item_id = a.item_id AND o.other_id = b.item_id GROUP BY 1",
    ),
)
def _(spark, folder):
    bags = catalogue(spark, folder).select("item_id", item_tokens(F.concat_ws(" ", "title", "brand")).alias("tokens"))
    return rounded(metrics.diversity(_predictions(spark, folder).join(bags, "item_id"), ["event_id"]))


@register(
    "validity",
    _pred_sql("v AS (SELECT item_id IN (SELECT p_partkey FROM part WHERE p_size > 10) AS good FROM pred)", select="SELECT count(*) AS predicted, count(*) FILTER (good) AS valid, round(count(*) FILTER (good) / count(*), 6) AS validity_rate, round(1 - count(*) FILTER (good) / count(*), 6) AS hallucination_rate, 1.0::DOUBLE AS adherence_rate FROM v"),
)
def _(spark, folder):
    known = table(spark, folder, "part").where("p_size > 10").select(F.col("p_partkey").alias("item_id"))
    return rounded(metrics.validity(_predictions(spark, folder), known))


@register("latency_summary", sql.query(sql.EVENTS, select="SELECT domain, count(rating) AS n, round(avg(rating), 6) AS mean, round(median(rating), 6) AS median, round(quantile_cont(rating, 0.95), 6) AS p95, quantile_disc(rating, 0.95) AS p95_nearest FROM ia GROUP BY domain"))
def _(spark, folder):
    return rounded(metrics.latency(event_interactions(spark, folder), "rating", ["domain"]))


_BY_TYPE = "mv AS (SELECT domain AS variant, 'mean_rating' AS metric, avg(rating) AS value FROM ia GROUP BY domain)"


@register("metric_deltas", sql.query(sql.EVENTS, _BY_TYPE, select="SELECT 1 AS dataset, m.variant, m.metric, round(m.value, 6) AS value, round(b.value, 6) AS base, round(m.value - b.value, 6) AS delta, round((b.value - m.value) / b.value, 6) AS sensitivity FROM mv m JOIN mv b ON b.variant = 'view' AND m.variant <> 'view'"))
def _(spark, folder):
    rows = event_interactions(spark, folder).groupBy(F.lit(1).alias("dataset"), F.col("domain").alias("variant"), F.lit("mean_rating").alias("metric")).agg(F.avg("rating").alias("value"))
    return rounded(stats.deltas(rows, "variant", "view", ["dataset"]))


_TOPS = """halves AS (SELECT user_id, event_id % 2 AS half, item_id, count(*) AS n FROM ia GROUP BY ALL),
tops AS (SELECT user_id, half, item_id, row_number() OVER (PARTITION BY user_id, half ORDER BY n DESC, item_id) AS rank FROM halves QUALIFY rank <= 10)"""


@register(
    "prediction_overlap",
    sql.query(sql.EVENTS, _TOPS, "j AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, a.rank AS ra, b.rank AS rb FROM (SELECT * FROM tops WHERE half = 0) a FULL JOIN (SELECT * FROM tops WHERE half = 1) b ON a.user_id = b.user_id AND a.item_id = b.item_id)",
              "k AS (SELECT user_id, count(*) AS u, count(*) FILTER (ra + rb IS NOT NULL) AS c, sum(ra) FILTER (rb IS NOT NULL) AS sa, sum(rb) FILTER (ra IS NOT NULL) AS sb, sum(ra * ra) FILTER (rb IS NOT NULL) AS saa, sum(rb * rb) FILTER (ra IS NOT NULL) AS sbb, sum(ra * rb) AS sab FROM j GROUP BY 1)",
              select="SELECT user_id, round(c / u, 6) AS overlap, CASE WHEN c < 2 THEN NULL WHEN (c * saa - sa * sa) * (c * sbb - sb * sb) = 0 THEN 0 ELSE round((c * sab - sa * sb) / sqrt(((c * saa - sa * sa) * (c * sbb - sb * sb))::DOUBLE), 6) END AS rank_correlation FROM k"),
)
def _(spark, folder):
    counts = event_interactions(spark, folder).groupBy("user_id", (F.col("event_id") % 2).alias("half"), "item_id").agg(F.count("*").cast("double").alias("score"))
    tops = rank.top_k(counts, ["user_id", "half"], 10)
    return rounded(stats.overlap(tops.where("half = 0"), tops.where("half = 1"), ["user_id"], 10))


@register(
    "paired_moments",
    sql.query(sql.EVENTS, "p AS (SELECT domain, user_id, avg(rating) FILTER (event_id % 2 = 0) AS a, avg(rating) FILTER (event_id % 2 = 1) AS b FROM ia GROUP BY ALL)", "d AS (SELECT domain, count(*) AS n, avg(a - b) AS m, var_samp(a - b) AS v FROM p WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1)", select="SELECT domain, n, round(m, 6) AS mean_delta, round(v, 6) AS variance, round(m / sqrt(v / n), 6) AS t, CASE WHEN m > 0 THEN 'improved' WHEN m < 0 THEN 'degraded' ELSE 'tied' END AS direction FROM d"),
)
def _(spark, folder):
    return rounded(stats.paired_moments(_halves(spark, folder), ["domain"]))


@register("paired_t_test")
def _(spark, folder):
    return stats.paired_t_test(_halves(spark, folder), ["domain"])


def _halves(spark, folder):
    even = F.col("event_id") % 2 == 0
    return event_interactions(spark, folder).groupBy("domain", "user_id").agg(F.avg(F.when(even, F.col("rating"))).alias("a"), F.avg(F.when(~even, F.col("rating"))).alias("b")).where("a is not null and b is not null")


@register("paired_resampling")
def _(spark, folder):
    return stats.resampled(_halves(spark, folder).withColumn("row", F.xxhash64("user_id")), ["domain"])


@register(
    "multiseed_summary",
    sql.query(sql.EVENTS, "r AS (SELECT domain, event_id % 3 AS seed, avg(rating) AS value FROM ia GROUP BY ALL)", select="SELECT domain, 'rating' AS metric, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(*) AS n, '3,4' AS missing_seeds FROM r GROUP BY domain"),
)
def _(spark, folder):
    rows = event_interactions(spark, folder).groupBy("domain", (F.col("event_id") % 3).alias("seed"), F.lit("rating").alias("metric")).agg(F.avg("rating").alias("value"))
    return rounded(stats.multiseed(rows, ["domain"], [0, 1, 2, 3, 4]))


@register("best_rows", sql.query(sql.EVENTS, "c AS (SELECT domain, item_id, count(*) AS n FROM ia GROUP BY ALL)", select="SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY domain ORDER BY n DESC, item_id) = 1"))
def _(spark, folder):
    return stats.best_rows(event_interactions(spark, folder).groupBy("domain", "item_id").agg(F.count("*").alias("n")), ["domain"], "n", ["item_id"])
