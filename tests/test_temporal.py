"""Node memories against a one-loop replay."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from tideloom.operators import temporal


def one_loop(events, encoder):
    """(kind, id) -> [(ts, memory)] by one pass over the events."""
    memory, versions = {}, {}
    for ts, user, item in sorted((t, u, i) for u, i, t in events):
        u, i = (memory.get(k, encoder.first(*k)) for k in ((0, user), (1, item)))
        x = np.concatenate([u, i, [math.log1p(max(ts, 0))]])[None]
        for kind, node, h in ((0, user, u), (1, item, i)):
            memory[kind, node] = encoder.gates[kind](x, h[None])[0]
            versions.setdefault((kind, node), []).append((ts, memory[kind, node]))
    return versions


def some_events(n=120, users=12, items=8, seed=1):
    rng = random.Random(seed)
    return [(rng.randrange(users), rng.randrange(items), 100 + 3 * k) for k in range(n)]


def table(spark, events):
    return spark.createDataFrame(events, "user_id long, item_id long, ts long").repartition(3)


def gathered(replayed):
    found = {}
    for r in sorted(replayed.collect(), key=lambda r: (r.ts, r.slice, r.seq)):
        found.setdefault((r.kind, r.id), []).append((r.ts, np.array(r.vec)))
    return found


def test_slices_without_a_second_event_of_a_node_are_the_exact_replay(spark):
    events, encoder = some_events(40), temporal.Encoder.drawn(6, seed=3)
    bounds, used = [], set()
    for u, i, t in events:  # a new slice wherever a node comes again
        if {(0, u), (1, i)} & used:
            bounds, used = [*bounds, t], set()
        used |= {(0, u), (1, i)}
    found, truth = gathered(temporal.replay(table(spark, events), encoder, bounds)), one_loop(events, encoder)
    assert found.keys() == truth.keys() and len(bounds) < len(events)
    for key, versions in truth.items():
        assert [t for t, _ in found[key]] == [t for t, _ in versions]
        np.testing.assert_allclose([v for _, v in found[key]], [v for _, v in versions], atol=1e-9)


def test_a_coarse_slice_folds_each_node_against_the_slice_start(spark):
    events, encoder = some_events(300, 5, 3), temporal.Encoder.drawn(4)
    found = gathered(temporal.replay(table(spark, events), encoder, [400]))
    state = {}
    for part in ([e for e in events if e[2] < 400], [e for e in events if e[2] >= 400]):
        start = dict(state)
        for kind in (0, 1):
            for e in part:
                own, other = (kind, e[kind]), (1 - kind, e[1 - kind])
                h, m = state.get(own, encoder.first(*own)), start.get(other, encoder.first(*other))
                x = np.concatenate([*((h, m) if kind == 0 else (m, h)), [math.log1p(e[2])]])
                state[own] = encoder.gates[kind](x[None], h[None])[0]
    for key, vec in state.items():
        np.testing.assert_allclose(found[key][-1][1], vec, atol=1e-9)
    exact = one_loop(events, encoder)
    drift = max(np.abs(found[k][-1][1] - exact[k][-1][1]).max() for k in state)
    assert 0 < drift < 0.1  # the stated difference of coarse slices


def test_scores_read_memories_before_the_case_alone(spark):
    events, encoder = some_events(), temporal.Encoder.drawn(5)
    versions = one_loop(events, encoder)
    rows = [(k, i, t, 0, n, v.tolist()) for (k, i), vs in versions.items() for n, (t, v) in enumerate(vs)]
    schema = "kind int, id long, ts long, slice int, seq long, vec array<double>"
    asked = [(n, n % 14, n % 9, 90 + 5 * n) for n in range(80)]

    def ask(rows):
        return {(r.event_id, r.item_id): r.score for r in temporal.ranked(spark.createDataFrame(asked, "event_id long, user_id long, item_id long, ts long"), spark.createDataFrame(rows, schema), encoder).collect()}

    found = ask(rows)
    for n, user, item, ts in asked:
        u, i = ([v for t, v in versions.get((k, node), []) if t < ts] or [encoder.first(k, node)] for k, node in ((0, user), (1, item)))
        assert found[n, item] == pytest.approx(float((u[-1] + encoder.time_weight * math.log1p(ts) + encoder.time_bias) @ i[-1]))
    later = [r for r in rows if r[2] < 300] + [(*r[:5], [9.0] * 5) for r in rows if r[2] >= 300]
    changed = ask(later)
    assert all(changed[n, i] == found[n, i] for n, _, i, ts in asked if ts <= 300) and changed != found


def test_replay_goes_on_from_a_memory_and_drops_odd_rows(spark):
    events, encoder = some_events(60), temporal.Encoder.drawn(4)
    whole = gathered(temporal.replay(table(spark, events), encoder, [190]))
    first = temporal.replay(table(spark, [e for e in events if e[2] < 190] + [(None, 1, 5), (1, None, 5)]), encoder, [])
    memory = first.groupBy("kind", "id").agg({"seq": "max"}).withColumnRenamed("max(seq)", "seq").join(first, ["kind", "id", "seq"])
    second = gathered(temporal.replay(table(spark, [e for e in events if e[2] >= 190]), encoder, [], memory))
    for key, versions in second.items():
        np.testing.assert_allclose(versions[-1][1], whole[key][-1][1], atol=1e-9)
    assert temporal.replay(table(spark, []), encoder, [5]).count() == 0 and temporal.time_bounds(table(spark, []), 1) == []
