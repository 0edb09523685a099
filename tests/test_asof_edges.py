"""As-of edges of a case's sources against brute force, over many slices of time and parts of the sources."""

from __future__ import annotations

import random
from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from tideloom.functions.cuts import ensure_checkpoint_dir
from tideloom.operators import asof, asof_edges

TIMED, MOVES = "event_id long, source_id long, ts long", "source_id long, target_id long, ts long, bucket long"


def drawn(seed):
    rng = random.Random(seed)
    moves = [(rng.choice([None, *range(6)]), rng.choice([None, *range(7)]), rng.randrange(100), rng.randrange(5)) for _ in range(400)]
    timed = [(100 + c, s, t) for c in range(40) for t in [rng.randrange(110)] for s in rng.sample(range(8), 4)]
    return [*timed, (1, None, 50), (2, 3, None), (None, 3, 50)], moves


def slow(timed, moves):
    found = {}
    for event, source, ts in timed:
        if event is None or source is None or ts is None:
            continue
        past = [m for m in moves if m[2] < ts]
        out = [m for m in past if m[0] == source]
        for target in {m[1] for m in out} - {None}:
            edge = [m for m in out if m[1] == target]
            share = len(edge) / len(out)
            lift = share / (sum(m[1] == target for m in past) / len(past))
            found[event, source, target] = (len(edge), share, lift, max(m[2] for m in edge), *[sum(m[3] == b for m in edge) for b in range(5)])
    return found


@pytest.mark.parametrize("asks, edges", [(10_000, 500_000), (7, 5), (25, 12)])
def test_edges_before_equal_brute_force(spark, asks, edges):
    timed, moves = drawn(asks)
    found = asof_edges.edges_before(spark.createDataFrame(timed, TIMED), spark.createDataFrame(moves, MOVES), None, asks, edges).collect()
    expected = slow(timed, moves)
    assert {tuple(r)[:3]: tuple(r)[3:] for r in found} == expected and len(found) == len(expected)


@pytest.mark.parametrize("score", ["support", "transition_probability", "lift", "pmi", "within_1w"])
def test_best_edges_merge_as_all_do(spark, score):
    timed, moves = (spark.createDataFrame(*x) for x in zip(drawn(3), (TIMED, MOVES), strict=True))
    merged = []
    for best in (None, (score, 2)):
        edges = asof_edges.edges_before(timed, moves, best, 20, 9).withColumn("pmi", F.log("lift"))
        merged.append(sorted(map(tuple, asof.merged_candidates(edges, score, "sum", 2).withColumn("score", F.round("score", 9)).collect())))
        count = edges.count() if best is None else None
        assert best or count > 200
    assert merged[0] == merged[1] and merged[0]


def test_no_pair_of_a_case_and_an_edge_is_written_down(spark):
    ensure_checkpoint_dir(spark)
    folder = Path(urlparse(spark.sparkContext.getCheckpointDir()).path)
    size = lambda: sum(p.stat().st_size for p in folder.rglob("part-*"))
    labelled = spark.range(12_000).selectExpr("id AS event_id", "id % 400 AS user_id", "crc32(string(id)) % 40 AS item_id", "id div 400 AS ts", "IF(id < 11600, 'train', 'test') AS split")
    before = size()
    found = asof.scored_edges(labelled.where("split = 'test'"), labelled)
    assert found.count() > 130_000
    assert size() - before < 500_000  # 1.4 MB where the pairs were kept
