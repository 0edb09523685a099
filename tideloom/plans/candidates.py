"""Queries: frozen candidate lists."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tideloom.functions.cuts import shared_folder
from tideloom.operators import frozen, rank
from tideloom.plans import sql
from tideloom.plans.base import test_cases
from tideloom.plans.registry import register
from tideloom.sources.tables import event_interactions

_SIZE = 20
_START = "((('0x' || sha256('0|' || row_id)[1:8])::BIGINT % n) * (4294967296 % n) + ('0x' || sha256('0|' || row_id)[9:16])::BIGINT) % n"
_LISTS = (
    sql.EVENTS,
    sql.SPLIT,
    sql.CASES,
    "slots AS (SELECT item_id, row_number() OVER (ORDER BY sha256('0|events|' || item_id), item_id) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT item_id FROM ia))",
    "ask AS (SELECT split || '|' || user_id || '|' || item_id AS row_id, item_id AS target FROM cases)",
    f"spin AS (SELECT row_id, target, {_START} AS start, n FROM ask CROSS JOIN (SELECT max(n) AS n FROM slots))",
    "slice AS (SELECT p.row_id, p.target, s.item_id, (s.place - p.start + n) % n AS o FROM (SELECT row_id, target, start FROM spin) p CROSS JOIN slots s)",
    f"lists AS (SELECT row_id, target, item_id FROM slice WHERE item_id <> target QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY o) < (SELECT least({_SIZE}, max(n)) FROM slots) UNION ALL SELECT row_id, target, target FROM ask)",
)


def _cases(spark, folder):
    return test_cases(spark, folder).select(rank.row_id(F.col("split"), F.col("user_id"), F.col("item_id")).alias("row_id"), "item_id")


def _lists(spark, folder):
    cases, items = _cases(spark, folder), event_interactions(spark, folder).select("item_id")
    return frozen.listed(frozen.ring_sample(cases, items, _SIZE, 0, "events"), cases), min(_SIZE, items.distinct().count())


@register("ring_candidates", sql.query(*_LISTS, select="SELECT row_id, item_id FROM lists"))
def _(spark, folder):
    return frozen.ring_sample(_cases(spark, folder), event_interactions(spark, folder), _SIZE, 0, "events")


@register("frozen_candidates", sql.query(*_LISTS, select="SELECT row_id, any_value(target)::VARCHAR AS target_item, array_to_string(list_sort(list(item_id::VARCHAR)), ',') AS candidates, (row_number() OVER (ORDER BY row_id) - 1) // 64 AS batch FROM lists GROUP BY row_id"))
def _(spark, folder):
    """Lists frozen in the shared folder, checked against their digest, and resolved in batches of 64 cases."""
    lists, size = _lists(spark, folder)
    place = f"{shared_folder(spark)}/frozen-{uuid.uuid4().hex}"
    sha256 = frozen.freeze(lists, place, size)["sha256"]
    asked = _cases(spark, folder).select("row_id", F.col("item_id").cast("string").alias("target_item"))
    found = frozen.batches(frozen.resolve(asked, place, sha256), 64, ["row_id"])
    return found.select("row_id", "target_item", F.array_join("candidate_items", ",").alias("candidates"), "batch")
