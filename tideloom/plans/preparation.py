"""Queries: preparation, splits and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideloom.operators import prep, sequences, splits
from tideloom.plans import sql
from tideloom.plans.base import rounded, split_events, train_events
from tideloom.plans.registry import register
from tideloom.sources import sinks
from tideloom.sources.tables import epoch_seconds, event_interactions, order_interactions, part_items, table


@register("interactions_events", sql.query(sql.EVENTS, select="SELECT * FROM ia"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return event_interactions(spark, folder)


@register("interactions_orders", sql.query(sql.ORDERS, select="SELECT domain, count(*) AS rows, sum(item_id) AS items, sum(ts) AS times, round(sum(rating), 6) AS ratings FROM ib GROUP BY domain"))
def _(spark, folder):
    return rounded(order_interactions(spark, folder).groupBy("domain").agg(F.count("*").alias("rows"), F.sum("item_id").alias("items"), F.sum("ts").alias("times"), F.sum("rating").alias("ratings")))


@register(
    "normalize_reviews",
    """SELECT CAST(user_id AS VARCHAR) AS user_id, json_extract_string(props, '$.k') AS item_id, epoch_us(ts) // 1000000 AS ts, value AS rating,
              CASE WHEN value < 5 THEN 'low_rating' END AS drop_reason FROM events""",
)
def _(spark, folder):
    raw = table(spark, folder, "events").select(F.col("user_id").cast("string").alias("reviewerID"), F.lit("").alias("parent_asin"), F.get_json_object("props", "$.k").alias("asin"), (epoch_seconds("ts") * 1000).alias("timestamp"), F.col("value").alias("overall"))
    return prep.normalize_interactions(raw, ("user_id", "reviewerID"), ("parent_asin", "asin"), ("timestamp", "unixReviewTime"), ("rating", "overall"), min_rating=5)


@register("item_text", "SELECT p_partkey AS item_id, concat_ws(' ', p_name, p_brand, p_type) AS text FROM part")
def _(spark, folder):
    return part_items(spark, folder).select("item_id", prep.item_text(["title", "brand", "category"]).alias("text"))


@register(
    "tie_stats",
    sql.query(sql.ORDERS, "g AS (SELECT user_id, ts, count(*) AS n FROM ib GROUP BY ALL HAVING count(*) > 1)", select="SELECT count(*) AS tied_groups, coalesce(sum(n), 0)::BIGINT AS tied_rows, coalesce(sum(n - 1), 0)::BIGINT AS extra_rows, count(DISTINCT user_id) AS tied_users, coalesce(max(n), 0) AS largest_group FROM g"),
)
def _(spark, folder):
    return prep.tie_stats(order_interactions(spark, folder))


@register("dedupe_first", sql.query(sql.EVENTS, select="SELECT * FROM ia QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts, event_id) = 1"))
def _(spark, folder):
    return prep.first_per_key(event_interactions(spark, folder), ["user_id", "item_id"], ["ts", "event_id"])


def _core_sql(users: int, items: int, rounds: int, simultaneous: bool) -> str:
    parts = [sql.ORDERS, "k0 AS MATERIALIZED (SELECT * FROM ib)"]
    for i in range(rounds):
        u = f"u{i} AS (SELECT * FROM k{i} WHERE user_id IN (SELECT user_id FROM k{i} GROUP BY 1 HAVING count(*) >= {users}))"
        base = f"k{i}" if simultaneous else f"u{i}"
        parts += [u, f"k{i + 1} AS MATERIALIZED (SELECT * FROM u{i} WHERE item_id IN (SELECT item_id FROM {base} GROUP BY 1 HAVING count(*) >= {items}))"]
    return sql.query(*parts, select=f"SELECT user_id, count(*) AS rows, sum(item_id)::BIGINT AS items, sum(ts)::BIGINT AS times FROM k{rounds} GROUP BY user_id")


def _core(spark, folder, simultaneous):
    kept = prep.k_core(order_interactions(spark, folder), 20, 20, simultaneous=simultaneous, error_when_empty=False)
    return kept.groupBy("user_id").agg(F.count("*").alias("rows"), F.sum("item_id").alias("items"), F.sum("ts").alias("times"))


@register("kcore_sequential", _core_sql(20, 20, 12, False))
def _(spark, folder):
    return _core(spark, folder, False)


@register("kcore_simultaneous", _core_sql(20, 20, 14, True))
def _(spark, folder):
    return _core(spark, folder, True)


def _domain_core_sql(users: int, items: int, rounds: int) -> tuple[list[str], int]:
    """Rounds that remove users and items by the counts of one table; rows of a round are what it removes."""
    parts = [sql.ORDERS, "k0 AS MATERIALIZED (SELECT * FROM ib)"]
    for i in range(rounds):
        parts.append(
            f"k{i + 1} AS MATERIALIZED (SELECT * FROM k{i} WHERE user_id IN (SELECT user_id FROM k{i} GROUP BY 1 HAVING count(*) >= {users})"
            f" AND (domain, item_id) IN (SELECT (domain, item_id) FROM k{i} GROUP BY domain, item_id HAVING count(*) >= {items}))"
        )
    return parts, rounds


_PARTS, _ROUNDS = _domain_core_sql(10, 4, 14)
_COUNTS = " UNION ALL ".join(
    f"SELECT {i + 1} AS round, (SELECT count(DISTINCT user_id) FROM k{i} WHERE user_id IN (SELECT user_id FROM k{i} GROUP BY 1 HAVING count(*) < 10)) AS users,"
    f" (SELECT count(*) FROM (SELECT domain, item_id FROM k{i} GROUP BY ALL HAVING count(*) < 4)) AS items, (SELECT count(*) FROM k{i}) - (SELECT count(*) FROM k{i + 1}) AS rows"
    for i in range(_ROUNDS)
)


def _domain_core(spark, folder):
    """Users with 10 orders lines over all priorities, items with 4 within one."""
    return prep.core_by_deltas(order_interactions(spark, folder), 10, 4, "domain")


@register("kcore_domains", sql.query(*_PARTS, select=f"SELECT user_id, domain, count(*) AS rows, sum(item_id)::BIGINT AS items, sum(ts)::BIGINT AS times FROM k{_ROUNDS} GROUP BY ALL"))
def _(spark, folder):
    kept, _ = _domain_core(spark, folder)
    return kept.groupBy("user_id", "domain").agg(F.count("*").alias("rows"), F.sum("item_id").alias("items"), F.sum("ts").alias("times"))


_MIN = """kept AS (SELECT * FROM ib WHERE user_id IN (SELECT user_id FROM ib GROUP BY 1 HAVING count(*) >= 30)
  AND item_id IN (SELECT item_id FROM ib GROUP BY 1 HAVING count(*) >= 28))"""


@register("min_count_filter", sql.query(sql.ORDERS, _MIN, select="SELECT item_id, count(*) AS rows FROM kept GROUP BY item_id"))
def _(spark, folder):
    return prep.min_counts(order_interactions(spark, folder), 30, 28).groupBy("item_id").agg(F.count("*").alias("rows"))


@register(
    "retention",
    sql.query(sql.ORDERS, _MIN, "a AS (SELECT domain, count(*) AS before_rows FROM ib GROUP BY 1)", "b AS (SELECT domain, count(*) AS after_rows FROM kept GROUP BY 1)", select="SELECT domain, before_rows, coalesce(after_rows, 0) AS after_rows, round(coalesce(after_rows, 0) / before_rows, 6) AS kept_share FROM a LEFT JOIN b USING (domain)"),
)
def _(spark, folder):
    rows = order_interactions(spark, folder)
    return rounded(prep.retention(rows, prep.min_counts(rows, 30, 28), "domain"))


@register("dense_ids", "SELECT c_name, row_number() OVER (ORDER BY c_name) - 1 AS user_id FROM (SELECT DISTINCT c_name FROM customer)")
def _(spark, folder):
    return prep.dense_ids(table(spark, folder, "customer"), "c_name", "user_id")


@register("event_ids", sql.query(sql.ORDERS, select="SELECT user_id, item_id, ts, rating, row_number() OVER (ORDER BY user_id, ts, item_id, rating) - 1 AS event_id FROM ib"))
def _(spark, folder):
    return prep.event_ids(order_interactions(spark, folder).select("user_id", "item_id", "ts", "rating"))


@register("duplicate_interactions", sql.query(sql.ORDERS, select="SELECT coalesce(sum(n - 1), 0)::BIGINT AS duplicates FROM (SELECT count(*) AS n FROM ib GROUP BY user_id, item_id, ts, domain)"))
def _(spark, folder):
    return prep.duplicate_count(order_interactions(spark, folder), ["user_id", "item_id", "ts", "domain"])


@register("dataset_summary", sql.query(sql.EVENTS, select="SELECT domain, count(*) AS rows, count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items, min(ts) AS first_ts, max(ts) AS last_ts FROM ia GROUP BY GROUPING SETS ((domain), ())"))
def _(spark, folder):
    return prep.summary(event_interactions(spark, folder), "domain")


@register(
    "subsample",
    sql.query(sql.EVENTS, "u AS (SELECT * FROM ia WHERE user_id IN (SELECT DISTINCT user_id FROM ia ORDER BY 1 LIMIT 10))", "i AS (SELECT * FROM u WHERE item_id IN (SELECT DISTINCT item_id FROM u ORDER BY 1 LIMIT 40))", select="SELECT * FROM i ORDER BY user_id, ts, item_id LIMIT 200"),
)
def _(spark, folder):
    return prep.subsample(event_interactions(spark, folder), 10, 40, 200)


@register("orphan_items", sql.query(sql.ORDERS, select="SELECT DISTINCT item_id FROM ib WHERE item_id NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)"))
def _(spark, folder):
    items = table(spark, folder, "part").where("p_size > 5").select(F.col("p_partkey").alias("item_id"))
    return prep.orphans(order_interactions(spark, folder), items)


@register(
    "readiness",
    sql.query(sql.EVENTS, "c AS (SELECT count(*) AS rows, count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items, count(*) FILTER (ts IS NULL) AS missing_ts FROM ia)", "o AS (SELECT count(DISTINCT item_id) AS orphans FROM ia WHERE item_id NOT IN (SELECT p_partkey FROM part))", select="SELECT *, round(1 - rows / (users * items), 6) AS sparsity, CASE WHEN rows = 0 THEN 'MISSING' WHEN missing_ts > 0 OR orphans > 0 THEN 'PARTIAL' ELSE 'READY' END AS verdict FROM c, o"),
)
def _(spark, folder):
    return rounded(prep.readiness(event_interactions(spark, folder), part_items(spark, folder)))


@register("interactions_with_items", sql.query(sql.EVENTS, select="SELECT category, brand, count(*) AS rows, count(DISTINCT user_id) AS users FROM ia LEFT JOIN (SELECT p_partkey AS item_id, p_type AS category, p_brand AS brand FROM part) USING (item_id) GROUP BY ALL"))
def _(spark, folder):
    return prep.with_items(event_interactions(spark, folder), part_items(spark, folder)).groupBy("category", "brand").agg(F.count("*").alias("rows"), F.count_distinct("user_id").alias("users"))


@register("loo_split", sql.query(sql.EVENTS, sql.SPLIT, select="SELECT event_id, user_id, item_id, ts, split FROM loo"))
def _(spark, folder):
    return split_events(spark, folder).select("event_id", "user_id", "item_id", "ts", "split")


@register("loo_split_summary", sql.query(sql.EVENTS, sql.SPLIT, select="SELECT split, count(*) AS rows, count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items FROM loo GROUP BY split"))
def _(spark, folder):
    return splits.summary(split_events(spark, folder))


_GLOBAL = """placed AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS p, count(*) OVER () AS n FROM ib),
cuts AS (SELECT min(ts) FILTER (p = CAST(floor(n * 0.8) AS BIGINT)) AS a, min(ts) FILTER (p = CAST(floor(n * 0.9) AS BIGINT)) AS b FROM placed),
g AS (SELECT ib.*, CASE WHEN ts < a THEN 'train' WHEN ts < b THEN 'val' ELSE 'test' END AS split FROM ib, cuts)"""


@register("global_time_split", sql.query(sql.ORDERS, _GLOBAL, select="SELECT split, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT user_id) AS users FROM g GROUP BY split"))
def _(spark, folder):
    return splits.global_time(order_interactions(spark, folder)).groupBy("split").agg(F.count("*").alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_distinct("user_id").alias("users"))


@register("positional_split", sql.query(sql.EVENTS, select="SELECT event_id, user_id, CASE WHEN event_id < CAST(floor(n * 0.8) AS BIGINT) THEN 'train' WHEN event_id < CAST(floor(n * 0.9) AS BIGINT) THEN 'val' ELSE 'test' END AS split FROM ia, (SELECT count(*) AS n FROM ia)"))
def _(spark, folder):
    return splits.positional(event_interactions(spark, folder), "event_id").select("event_id", "user_id", "split")


@register("user_leakage", sql.query(sql.EVENTS, sql.SPLIT, select="SELECT count(*) AS leaking_users FROM (SELECT user_id FROM loo GROUP BY 1 HAVING max(ts) FILTER (split = 'train') > min(ts) FILTER (split = 'val') OR max(ts) FILTER (split = 'val') > min(ts) FILTER (split = 'test'))"))
def _(spark, folder):
    return splits.user_leaks(split_events(spark, folder)).agg(F.count("*").alias("leaking_users"))


@register("global_leakage", sql.query(sql.ORDERS, _GLOBAL, select="SELECT count(*) FILTER (a >= b OR c >= d) AS overlaps FROM (SELECT max(ts) FILTER (split = 'train') AS a, min(ts) FILTER (split = 'val') AS b, max(ts) FILTER (split = 'val') AS c, min(ts) FILTER (split = 'test') AS d FROM g)"))
def _(spark, folder):
    return splits.global_leaks(splits.global_time(order_interactions(spark, folder))).agg(F.count("*").alias("overlaps"))


_TIME = 1_705_276_800


@register("train_as_of", sql.query(sql.EVENTS, sql.SPLIT, select=f"SELECT item_id, count(*) AS rows FROM loo WHERE split = 'train' AND ts < {_TIME} GROUP BY item_id"))
def _(spark, folder):
    return splits.as_of(split_events(spark, folder), _TIME).groupBy("item_id").agg(F.count("*").alias("rows"))


_GAPS = """gaps AS (
  SELECT *, CASE WHEN gap IS NULL THEN 'unknown' WHEN gap <= 3600 THEN 'same_session' WHEN gap <= 86400 THEN 'same_day' WHEN gap <= 604800 THEN 'same_week' WHEN gap <= 2592000 THEN 'same_month' ELSE 'old' END AS bucket
  FROM (SELECT user_id, item_id, ts, row_number() OVER w - 1 AS place, ts - lag(ts) OVER w AS gap FROM ia WINDOW w AS (PARTITION BY user_id ORDER BY ts, item_id)))"""


@register("gap_features", sql.query(sql.EVENTS, _GAPS, select="SELECT * FROM gaps"))
def _(spark, folder):
    return sequences.gaps(event_interactions(spark, folder))


@register("gap_bucket_counts", sql.query(sql.EVENTS, _GAPS, select="SELECT bucket, count(*) AS n, min(gap) AS least, max(gap) AS most FROM gaps GROUP BY bucket"))
def _(spark, folder):
    return sequences.gaps(event_interactions(spark, folder)).groupBy("bucket").agg(F.count("*").alias("n"), F.min("gap").alias("least"), F.max("gap").alias("most"))


_HISTORY = "h AS (SELECT user_id, list(item_id ORDER BY ts, event_id) AS items FROM loo WHERE split = 'train' GROUP BY user_id)"


def _histories(spark, folder):
    return sequences.histories(train_events(spark, folder))


def _text(array):
    return F.array_join(array.cast("array<string>"), ",")


@register("user_histories", sql.query(sql.EVENTS, sql.SPLIT, _HISTORY, select="SELECT user_id, array_to_string(items, ',') AS items FROM h"))
def _(spark, folder):
    return _histories(spark, folder).select("user_id", _text(F.col("items")).alias("items"))


@register(
    "recency_blocks",
    sql.query(sql.EVENTS, sql.SPLIT, _HISTORY, select="SELECT user_id, array_to_string(items[1:len(items) // 3], ',') AS long_term, array_to_string(items[len(items) // 3 + 1:2 * len(items) // 3], ',') AS mid_term, array_to_string(items[2 * len(items) // 3 + 1:], ',') AS short_term FROM h"),
)
def _(spark, folder):
    blocks = _histories(spark, folder).select("user_id", sequences.recency_blocks(F.col("items")).alias("b"))
    return blocks.select("user_id", *[_text(F.col(f"b.{n}")).alias(n) for n in ("long_term", "mid_term", "short_term")])


@register(
    "sequence_transforms",
    sql.query(
        sql.EVENTS,
        sql.SPLIT,
        _HISTORY,
        select="""SELECT user_id, array_to_string(list_reverse(items), ',') AS reversed, array_to_string(items[-5:], ',') AS recent_5, array_to_string(items[1:greatest(len(items) - 5, 0)], ',') AS without_recent_5,
                array_to_string(list_concat(list_transform(range(greatest(100 - len(items), 0)), lambda x: 0), items[-100:]), ',') AS padded_100 FROM h""",
    ),
)
def _(spark, folder):
    items = F.col("items")
    return _histories(spark, folder).select("user_id", _text(F.reverse(items)).alias("reversed"), _text(sequences.tail(items, 5)).alias("recent_5"), _text(sequences.remove_recent(items, 5)).alias("without_recent_5"), _text(sequences.left_pad(items, 100)).alias("padded_100"))


@register(
    "recent_unique_items",
    sql.query(sql.EVENTS, sql.SPLIT, "r AS (SELECT user_id, item_id, max(ts) AS t, arg_max(event_id, (ts, event_id)) AS e FROM loo WHERE split = 'train' GROUP BY ALL)", "n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, e DESC) AS p FROM r)", select="SELECT user_id, string_agg(item_id::VARCHAR, ',' ORDER BY p) AS items FROM n WHERE p <= 10 GROUP BY user_id"),
)
def _(spark, folder):
    return _histories(spark, folder).select("user_id", _text(sequences.recent_unique(F.col("items"), 10)).alias("items"))


@register(
    "hash_shuffled_sequences",
    sql.query(
        sql.EVENTS,
        sql.SPLIT,
        "p AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM loo WHERE split = 'train')",
        select="SELECT user_id, string_agg(item_id::VARCHAR, ',' ORDER BY sha256('7|' || user_id || '|' || i || '|' || item_id), item_id) AS items FROM p GROUP BY user_id",
    ),
)
def _(spark, folder):
    return _histories(spark, folder).select("user_id", _text(sequences.hash_shuffled(F.col("items"), F.col("user_id"), 7)).alias("items"))


@register(
    "popularity_sorted_sequences",
    sql.query(sql.EVENTS, sql.SPLIT, "t AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS c FROM loo WHERE split = 'train')", select="SELECT user_id, string_agg(item_id::VARCHAR, ',' ORDER BY c DESC, item_id) AS items FROM t GROUP BY user_id"),
)
def _(spark, folder):
    train = train_events(spark, folder)
    return sequences.popularity_sorted(train, train.groupBy("item_id").count()).select("user_id", _text(F.col("items")).alias("items"))


@register(
    "evaluation_examples",
    sql.query(
        sql.EVENTS,
        sql.SPLIT,
        select="""SELECT c.event_id, c.user_id, c.item_id, c.ts, c.split, array_to_string((list(m.item_id ORDER BY m.ts, m.event_id))[-50:], ',') AS history
                  FROM loo c JOIN loo m ON m.user_id = c.user_id AND m.split <> 'test' AND (c.split = 'test' OR m.split = 'train') WHERE c.split <> 'train' GROUP BY ALL""",
    ),
)
def _(spark, folder):
    return sequences.examples(split_events(spark, folder)).withColumn("history", _text(F.col("history")))


@register(
    "train_prefixes",
    sql.query(
        sql.EVENTS,
        sql.SPLIT,
        select="""SELECT * FROM (SELECT event_id, user_id, item_id, ts, array_to_string(list(item_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), ',') AS history
                  FROM loo WHERE split = 'train') WHERE history <> ''""",
    ),
)
def _(spark, folder):
    return sequences.prefixes(split_events(spark, folder), 20).withColumn("history", _text(F.col("history")))


@register("export_typed_interactions", sql.query(sql.EVENTS, sql.SPLIT, select="""SELECT user_id::VARCHAR AS "user_id:token", item_id::VARCHAR AS "item_id:token", rating::FLOAT AS "rating:float", ts::DOUBLE AS "timestamp:float" FROM loo WHERE split = 'train'"""))
def _(spark, folder):
    return sinks.typed_interactions(train_events(spark, folder))


@register("export_typed_items", """SELECT p_partkey::VARCHAR AS "item_id:token", p_name AS "title:token_seq" FROM part""")
def _(spark, folder):
    return sinks.typed_items(part_items(spark, folder))


@register("metric_rows", sql.query(sql.EVENTS, select="UNPIVOT (SELECT domain, count(*)::DOUBLE AS events, count(DISTINCT user_id)::DOUBLE AS users FROM ia GROUP BY domain) ON events, users INTO NAME metric VALUE value"))
def _(spark, folder):
    wide = event_interactions(spark, folder).groupBy("domain").agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users"))
    return sinks.metric_rows(wide, ["domain"])


@register(
    "training_examples",
    sql.query(
        sql.EVENTS,
        sql.SPLIT,
        "pl AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS place FROM (SELECT DISTINCT item_id FROM ia))",
        "r AS (SELECT event_id, user_id, ts, place FROM loo JOIN pl USING (item_id) WHERE split = 'train')",
        "o AS (SELECT user_id, list(DISTINCT place ORDER BY place) AS own FROM r GROUP BY 1)",
        "h AS (SELECT event_id, user_id, place, list(place + 1) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS past FROM r)",
        "d AS (SELECT event_id, j, ('0x' || substr(sha256('0|' || event_id || '|' || j), 1, 12))::BIGINT % ((SELECT count(*) FROM pl) - len(own)) AS x, own FROM h JOIN o USING (user_id) CROSS JOIN range(3) t(j) WHERE past IS NOT NULL)",
        "n AS (SELECT event_id, list(x + len(list_filter(own, lambda y, i: y - (i - 1) <= x)) + 1 ORDER BY j) AS negatives FROM d GROUP BY event_id)",
        select="SELECT event_id, array_to_string(list_resize([]::BIGINT[], 5 - len(past), 0) || past, ',') AS input, place + 1 AS positive, array_to_string(negatives, ',') AS negatives FROM h JOIN n USING (event_id)",
    ),
)
def _(spark, folder):
    found = sequences.training_examples(train_events(spark, folder), event_interactions(spark, folder), 5, 3)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return found.select("event_id", text("input"), "positive", text("negatives"))


@register(
    "item_vectors",
    sql.query(
        sql.EVENTS,
        sql.SPLIT,
        "c AS (SELECT item_id, count(*) AS n, max(ts) AS ts FROM loo WHERE split = 'train' GROUP BY 1)",
        "w AS (SELECT p_partkey AS item_id, list_distinct(list_filter(regexp_split_to_array(lower(concat_ws(' ', p_name, p_type)), '\\s+'), lambda x: x <> '')) AS l FROM part)",
        select="SELECT item_id, len(l)::DOUBLE AS words, list_sum(list_transform(l, lambda x: len(x)))::DOUBLE AS characters, n::DOUBLE AS seen, ts::DOUBLE AS at, (n + 2) / 4 AS third, (n + 3) / 4 AS fourth FROM w JOIN c USING (item_id)",
    ),
)
def _(spark, folder):
    seen = train_events(spark, folder).groupBy("item_id").agg(F.count("*").alias("n"), F.max("ts").alias("ts"))
    rows = part_items(spark, folder).join(seen, "item_id").select("item_id", sequences.text_vector(["title", "category"]).alias("t"), sequences.memory_vector(F.col("n"), F.col("ts")).alias("m"))
    return rows.select("item_id", F.col("t")[0].alias("words"), F.col("t")[1].alias("characters"), *[F.col("m")[i].alias(n) for i, n in enumerate(("seen", "at", "third", "fourth"))])
