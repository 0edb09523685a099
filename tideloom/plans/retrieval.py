"""Queries: what was known of the edges before each case, and candidates by every score and merge."""

from __future__ import annotations


from tideloom.operators import asof
from tideloom.plans import sql
from tideloom.plans.base import rounded, split_events, test_cases
from tideloom.plans.registry import register

_BEFORE = """moved AS (SELECT *, target_ts - source_ts AS gap FROM strict),
known AS (
  SELECT s.event_id, s.source_id, k.target_id, c.ts, count(*) AS support, max(k.target_ts) AS last_ts, count(*) FILTER (gap <= 1800) AS gap_same_session,
    count(*) FILTER (gap > 1800 AND gap <= 86400) AS gap_within_1d, count(*) FILTER (gap > 86400 AND gap <= 604800) AS gap_within_1w,
    count(*) FILTER (gap > 604800 AND gap <= 2592000) AS gap_within_1m, count(*) FILTER (gap > 2592000) AS gap_long_gap
  FROM sources s JOIN cases c USING (event_id) JOIN moved k ON k.source_id = s.source_id AND k.target_ts < c.ts GROUP BY ALL),
outgoing AS (SELECT s.event_id, s.source_id, count(*)::DOUBLE AS source_count FROM sources s JOIN cases c USING (event_id) JOIN moved k ON k.source_id = s.source_id AND k.target_ts < c.ts GROUP BY ALL),
incoming AS (SELECT n.event_id, n.target_id, count(*)::DOUBLE AS target_count FROM (SELECT DISTINCT event_id, target_id, ts FROM known) n JOIN moved k ON k.target_id = n.target_id AND k.target_ts < n.ts GROUP BY ALL),
alltime AS (SELECT c.event_id, count(k.target_ts)::DOUBLE AS total FROM cases c LEFT JOIN moved k ON k.target_ts < c.ts GROUP BY ALL),
scored AS (
  SELECT *, support / source_count AS transition_probability, (support / source_count) / (target_count / total) AS lift, ln((support / source_count) / (target_count / total)) AS pmi
  FROM known JOIN outgoing USING (event_id, source_id) JOIN incoming USING (event_id, target_id) JOIN alltime USING (event_id))"""


def _edges(spark, folder, best=None):
    return asof.scored_edges(test_cases(spark, folder), split_events(spark, folder), best=best)


@register(
    "asof_edge_scores",
    sql.query(
        sql.EVENTS,
        sql.SPLIT,
        sql.CASES,
        sql.RETRIEVAL,
        _BEFORE,
        select="SELECT event_id, source_id, target_id, support, round(transition_probability, 6) AS transition_probability, round(lift, 6) AS lift, round(pmi, 6) AS pmi, last_ts, gap_same_session, gap_within_1d, gap_within_1w, gap_within_1m, gap_long_gap FROM scored",
    ),
)
def _(spark, folder):
    return rounded(_edges(spark, folder))


@register(
    "asof_transitions_so_far",
    sql.query(sql.EVENTS, sql.SPLIT, sql.CASES, select="SELECT c.event_id, (SELECT count(*) FROM loo t WHERE t.split = 'train' AND t.ts < c.ts) AS so_far FROM cases c"),
)
def _(spark, folder):
    return asof.all_before(test_cases(spark, folder), split_events(spark, folder).where("split = 'train'"), "so_far")


def _merged_sql(column: str, merge: str, per_source: int) -> str:
    return f"""SELECT event_id, target_id AS candidate_id, round({merge}(s), 6)::DOUBLE AS score, sum(support)::BIGINT AS support, max(last_ts) AS last_ts, count(*) AS sources FROM (
  SELECT *, {column}::DOUBLE AS s FROM scored WHERE {column} > 0
  QUALIFY row_number() OVER (PARTITION BY event_id, source_id ORDER BY {column}::DOUBLE DESC, support DESC, last_ts DESC, target_id) <= {per_source}) GROUP BY ALL"""


def _register(score: str, merge: str) -> None:
    column = f"gap_{score}" if score in asof.GAP_BUCKETS else score

    @register(f"asof_{score}_{merge}", sql.query(sql.EVENTS, sql.SPLIT, sql.CASES, sql.RETRIEVAL, _BEFORE, select=_merged_sql(column, merge, 5)))
    def _(spark, folder):
        """The five best edges of each source, so that the order of ties shows."""
        return rounded(asof.merged_candidates(_edges(spark, folder, (score, 5)), score, merge, 5))


for _score in (*asof.SCORES, "within_1w"):
    for _merge in ("max", "sum"):
        _register(_score, _merge)
