"""SQL fragments that the oracle queries share."""

from __future__ import annotations

EVENTS = """ia AS (
  SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id,
         epoch_us(ts) // 1000000 AS ts, value AS rating, event_type AS domain
  FROM events)"""

ORDERS = """ib AS (
  SELECT o_custkey AS user_id, l_partkey AS item_id, epoch_us(o_orderdate) // 1000000 AS ts,
         l_quantity AS rating, o_orderpriority AS domain
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

SPLIT = """loo AS (
  SELECT *, CASE row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)
              WHEN 1 THEN 'test' WHEN 2 THEN 'val' ELSE 'train' END AS split
  FROM ia)"""

TRAIN_PAIRS = """pairs AS (
  SELECT * FROM (
    SELECT user_id, lag(item_id) OVER w AS source_id, item_id AS target_id, lag(ts) OVER w AS source_ts,
           ts AS target_ts, ts - lag(ts) OVER w AS gap
    FROM loo WHERE split = 'train' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
  WHERE source_id IS NOT NULL AND gap > 0)"""

EDGES = """edges AS (
  SELECT source_id, target_id, count(*) AS support, max(target_ts) AS last_ts, avg(gap) AS mean_gap
  FROM pairs GROUP BY ALL)"""

ALL_TRANSITIONS = """moves AS (
  SELECT source_id, target_id, count(*) AS count, count(DISTINCT user_id) AS user_count, avg(gap) AS mean_gap, median(gap) AS median_gap,
         count(*) FILTER (gap <= 3600) AS n_same_session, count(*) FILTER (gap > 3600 AND gap <= 86400) AS n_same_day,
         count(*) FILTER (gap > 86400 AND gap <= 604800) AS n_same_week, count(*) FILTER (gap > 604800 AND gap <= 2592000) AS n_same_month,
         count(*) FILTER (gap > 2592000) AS n_old, count(*) FILTER (gap IS NULL) AS n_unknown
  FROM (SELECT user_id, lag(item_id) OVER w AS source_id, item_id AS target_id, ts - lag(ts) OVER w AS gap, row_number() OVER w AS r
        FROM loo WHERE split = 'train' WINDOW w AS (PARTITION BY user_id ORDER BY ts, item_id))
  WHERE r > 1 GROUP BY source_id, target_id)"""

#: The rarest fifth of the items of pop(item_id, n).
TAIL = "tail AS (SELECT item_id FROM (SELECT item_id, row_number() OVER (ORDER BY n, item_id::VARCHAR) AS r, count(*) OVER () AS m FROM pop) WHERE r <= greatest(1, round_even(0.2 * m, 0)))"

CASES = "cases AS (SELECT * FROM loo WHERE split = 'test')"

#: Sources, strict transitions, per-source shares, the merged candidates and the target's rank of each test case.
RETRIEVAL = """mine AS (SELECT * FROM loo WHERE split <> 'test'),
sources AS (
  SELECT event_id, source_id, recency FROM (
    SELECT event_id, source_id, row_number() OVER (PARTITION BY event_id ORDER BY t DESC, e DESC) AS recency FROM (
      SELECT c.event_id, m.item_id AS source_id, max(m.ts) AS t, arg_max(m.event_id, (m.ts, m.event_id)) AS e
      FROM cases c JOIN mine m ON m.user_id = c.user_id AND m.ts < c.ts GROUP BY ALL)) WHERE recency <= 20),
sized AS (SELECT *, count(*) OVER (PARTITION BY user_id, ts) AS n FROM loo WHERE split = 'train'),
strict AS (
  SELECT source_id, target_id, source_ts, target_ts, user_id FROM (
    SELECT user_id, lag(item_id) OVER w AS source_id, item_id AS target_id, lag(ts) OVER w AS source_ts, ts AS target_ts, lag(n) OVER w AS b
    FROM sized WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE source_ts < target_ts AND b = 1),
met AS (
  SELECT s.event_id, s.source_id, k.target_id, count(*) AS support
  FROM sources s JOIN cases c USING (event_id) JOIN strict k ON k.source_id = s.source_id AND k.target_ts < c.ts GROUP BY ALL),
shares AS (SELECT *, support / sum(support) OVER (PARTITION BY event_id, source_id) AS score FROM met),
best AS (SELECT * FROM shares QUALIFY row_number() OVER (PARTITION BY event_id, source_id ORDER BY score DESC, target_id) <= 50),
merged AS (SELECT event_id, target_id AS candidate_id, max(score) AS score FROM best GROUP BY ALL),
seen AS (SELECT DISTINCT c.event_id, m.item_id AS candidate_id FROM cases c JOIN mine m ON m.user_id = c.user_id AND m.ts < c.ts AND m.item_id <> c.item_id),
retrieved AS (
  SELECT event_id, candidate_id, score, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, candidate_id) AS rank
  FROM merged m WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.event_id = m.event_id AND s.candidate_id = m.candidate_id)),
ranks AS (SELECT c.event_id, c.user_id, c.item_id, c.ts, r.rank FROM cases c LEFT JOIN retrieved r ON r.event_id = c.event_id AND r.candidate_id = c.item_id)"""


def query(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


def ranking_columns(ks: tuple[int, ...]) -> str:
    """Measures over a column `rank`, rounded."""
    out = ["count(*) AS cases"]
    for k in ks:
        out += [f"round(avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END), 6) AS hr_{k}", f"round(avg(CASE WHEN rank <= {k} THEN 1 / log2(rank + 1) ELSE 0.0 END), 6) AS ndcg_{k}", f"round(avg(CASE WHEN rank <= {k} THEN 1.0 / rank ELSE 0.0 END), 6) AS mrr_{k}"]
    return ", ".join(out)
