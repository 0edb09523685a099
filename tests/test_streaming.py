"""Ordered transitions: arrivals in any order within the lateness give the batch result."""

from __future__ import annotations

import random

import pytest

from tideloom.operators import graph
from tideloom.streaming import transitions as streams

SCHEMA = "user_id long, item_id long, ts long, event_id long"
LATE = 3600


def _drain(spark, place, batches):
    """Each list of rows as one micro-batch; the emitted transitions, and how many rows came too late."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{place}/in/{i:03d}")
        read = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{place}/in/*")
        query = streams.ordered_transitions(read, "1 hour").writeStream.outputMode("append").format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    return sorted(map(tuple, spark.read.parquet(f"{place}/out").collect()))


@pytest.mark.parametrize("cuts", [2, 5])
def test_shuffled_arrivals_equal_the_batch(spark, tmp_path, cuts):
    draw = random.Random(cuts)
    rows = [(draw.randrange(4), draw.randrange(9), 60 * draw.randrange(300), event) for event in range(240)]
    arriving = sorted(rows, key=lambda r: r[2] + draw.random() * (LATE - 1))
    assert arriving != sorted(rows, key=lambda r: r[2])
    size = -(-len(rows) // cuts)
    batches = [arriving[i : i + size] for i in range(0, len(rows), size)]
    closing = [(99, 0, 10**6, 10**6)]  # a row of another user whose time passes all others
    expected = sorted(map(tuple, graph.strict_transitions(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert _drain(spark, tmp_path, [*batches, closing]) == expected and len(expected) > 50


def test_rows_under_the_watermark_and_open_rows(spark, tmp_path):
    first = [(1, 10, 0, 0), (1, 11, 60, 1), (1, None, 70, 2), (None, 3, 80, 3)]
    then = [(1, 12, 20_000, 4)]  # the watermark goes to 16,400
    late = [(1, 13, 30, 5), (1, 14, 19_000, 6)]  # the first is dropped, the second waits
    found = _drain(spark, tmp_path, [first, then, late])
    assert found == [(1, 10, 11, 0, 60, 60)]
    assert _drain(spark, f"{tmp_path}/again", [first, then, late, [(2, 1, 90_000, 7)]]) == [(1, 10, 11, 0, 60, 60), (1, 11, 14, 60, 19_000, 18_940), (1, 14, 12, 19_000, 20_000, 1_000)]


def test_an_event_at_the_end_of_a_session_begins_another(spark, tmp_path):
    times = [(1, 0), (1, 1799), (1, 1799 + 1800), (2, 5), (2, 5 + 1800), (3, 10**6)]  # the last closes what is before it
    spark.createDataFrame(times, "user_id long, ts long").selectExpr("user_id", "timestamp_seconds(ts) AS event_time").coalesce(1).write.parquet(f"{tmp_path}/in/a")
    read = spark.readStream.schema("user_id long, event_time timestamp").parquet(f"{tmp_path}/in/*")
    query = streams.stream_sessions(read).writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/out").selectExpr("user_id", "unix_seconds(session_start)", "unix_micros(session_end) / 1e6", "events").collect()
    assert sorted(map(tuple, found)) == [(1, 0, 3599.0, 2), (1, 3599, 5399.0, 1), (2, 5, 1805.0, 1), (2, 1805, 3605.0, 1)]
