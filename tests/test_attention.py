"""The self-attention model against finite differences and all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from tideloom.operators import attention

LENGTH, SIZE, ITEMS = 5, 6, 12


def some(seed=1, rows=7, negatives=2):
    rng = np.random.default_rng(seed)
    w = attention.drawn_weights(SIZE, LENGTH, seed)
    w = {k: v + rng.normal(0, 0.1, v.shape) for k, v in w.items()}
    ids = np.array([[0] * k + list(rng.integers(1, ITEMS + 1, LENGTH - k)) for k in rng.integers(0, LENGTH, rows)])
    table = np.vstack([np.zeros(SIZE), rng.normal(0, 1, (ITEMS, SIZE))])
    return w, ids, table, rng.integers(1, ITEMS + 1, rows), rng.integers(1, ITEMS + 1, (rows, negatives))


def test_gradients_equal_finite_differences():
    w, ids, table, pos, neg = some()
    loss = lambda w, table: attention.loss_and_gradients(table[ids], ids > 0, table[pos], table[neg], w)[0]
    _, gx, gp, gn, grads = attention.loss_and_gradients(table[ids], ids > 0, table[pos], table[neg], w)
    rng, step = np.random.default_rng(5), 1e-6
    for name, value in w.items():
        for at in rng.choice(value.size, min(6, value.size), replace=False):
            up, down = ({**w, name: value + s * np.eye(1, value.size, at).reshape(value.shape)} for s in (step, -step))
            assert grads[name].ravel()[at] == pytest.approx((loss(up, table) - loss(down, table)) / (2 * step), abs=1e-6), name
    total = np.zeros_like(table)
    for places, g in ((ids, gx), (pos, gp), (neg, gn)):
        np.add.at(total, places, g)
    for item in range(1, ITEMS + 1):
        d = np.zeros_like(table)
        d[item, item % SIZE] = step
        assert total[item, item % SIZE] == pytest.approx((loss(w, table + d) - loss(w, table - d)) / (2 * step), abs=1e-6)


def test_a_later_item_changes_no_earlier_state():
    w, ids, table, *_ = some(2)
    changed = ids.copy()
    changed[:, -1] = ids[:, -1] % ITEMS + 1
    a, b = (attention.forward(table[x], x > 0, w)[0] for x in (ids, changed))
    np.testing.assert_array_equal(a[:, :-1], b[:, :-1])
    assert not np.allclose(a[:, -1], b[:, -1])


def example_table(spark, n=60):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):  # the next item follows the last by one
        last = int(rng.integers(1, ITEMS))
        rows.append((i, [0, 0, int(rng.integers(1, ITEMS + 1)), int(rng.integers(1, ITEMS + 1)), last], last + 1, [int(x) for x in rng.integers(1, ITEMS + 1, 2)]))
    return spark.createDataFrame([*rows, (n, [0, 0, 0, 0, 1], 2, [])], "event_id long, input array<long>, positive long, negatives array<long>")


def fitted(spark, parts, steps):
    items = attention.item_table(spark.range(1, ITEMS + 1).withColumnRenamed("id", "place"), SIZE, 4)
    return attention.fit(example_table(spark).repartition(parts), items, attention.drawn_weights(SIZE, LENGTH, 4), steps, rate=1.0)


def test_steps_equal_one_machine_and_any_partitioning(spark):
    one, other = fitted(spark, 1, 3), fitted(spark, 5, 3)
    w, rate = attention.drawn_weights(SIZE, LENGTH, 4), 1.0
    table = np.vstack([np.zeros(SIZE), *[np.random.default_rng([4, p]).normal(0, 0.02, SIZE) for p in range(1, ITEMS + 1)]])
    rows = [r for r in example_table(spark).collect() if r.negatives]
    ids, pos, neg = np.array([r.input for r in rows]), np.array([r.positive for r in rows]), np.array([r.negatives for r in rows])
    losses = []
    for _ in range(3):
        loss, gx, gp, gn, grads = attention.loss_and_gradients(table[ids], ids > 0, table[pos], table[neg], w)
        losses.append(loss / len(rows))
        total = np.zeros_like(table)
        for places, g in ((ids, gx), (pos, gp), (neg, gn)):
            np.add.at(total, places, g)
        total[0] = 0
        table = table - rate / len(rows) * total
        w = {k: v - rate / len(rows) * grads[k] for k, v in w.items()}
    for items, weights, found in (one, other):
        assert found == pytest.approx(losses, abs=1e-9) and found[-1] < found[0]
        for r in items.collect():
            np.testing.assert_allclose(r.vec, table[r.place], atol=1e-9)
        for k in w:
            np.testing.assert_allclose(weights[k], w[k], atol=1e-9)


def test_scores_equal_all_pairs(spark):
    w, ids, table, *_ = some(6, rows=9)
    items = spark.createDataFrame([(p, table[p].tolist()) for p in range(1, ITEMS + 1)], "place long, vec array<double>")
    cases = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(ids)] + [(99, [0] * LENGTH)], "event_id long, input array<long>").repartition(3)
    last = attention.forward(table[ids], ids > 0, w)[0][:, -1]
    truth = last @ table[1:].T
    best = {(r.event_id, r["rank"]): (r.place, r.score) for r in attention.top_k(cases, items, w, 4).collect()}
    for i, scores in enumerate(truth):
        order = sorted(range(ITEMS), key=lambda p: (-round(scores[p], 6), p))[:4]
        assert [best[i, k + 1][0] for k in range(4)] == [p + 1 for p in order]
    pool = cases.select("event_id").crossJoin(items.where("place % 2 = 0").select("place"))
    for r in attention.score_pool(pool, cases, items, w).collect():
        assert r.score == pytest.approx(0.0 if r.event_id == 99 else truth[r.event_id][r.place - 1])


def test_a_vector_is_sent_once_a_block(spark):
    blocks = attention.training_blocks(example_table(spark, 2_000).repartition(3), LENGTH)
    rows = blocks.collect()
    assert len(rows) == 3 and sum(len(r.widths) // 4 for r in rows) == 2_000  # the example without negatives is left out
    assert sum(len(r.unique) for r in rows) <= 3 * (ITEMS + 1)  # and not 2,000 x 8
    odd = spark.createDataFrame([(1, [0, 0, 7]), (2, [None, 9, 7, 3]), (3, None)], "event_id long, places array<long>").coalesce(1)
    r = attention.packed(odd).first()
    places = np.r_[0, r.unique][np.frombuffer(r.local, np.int32)]
    assert places.tolist() == [0, 0, 7, 0, 9, 7, 3] and np.frombuffer(r.widths, np.int32).tolist() == [3, 4] and np.frombuffer(r.events, np.int64).tolist() == [1, 2]
