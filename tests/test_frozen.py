"""Frozen candidate lists: freeze, resolve, tamper, fail; and the k-core by deltas against the recount."""

from __future__ import annotations

import hashlib
import random

import pytest

from tideloom.operators import frozen, prep


def slow_slice(catalogue, target, size, seed, dataset, row_id):
    ring = [i for _, i in sorted((hashlib.sha256(f"{seed}|{dataset}|{i}".encode()).hexdigest(), i) for i in catalogue)]
    start = int.from_bytes(hashlib.sha256(f"{seed}|{row_id}".encode()).digest()[:8], "big") % len(ring)
    others = [i for i in (ring[(start + k) % len(ring)] for k in range(len(ring))) if i != target]
    return {*others[: min(size, len(ring)) - 1], target}


def case_table(spark, n=60, items=23):
    return spark.createDataFrame([(f"test|u{k}|{k % items}", k % items) for k in range(n)], "row_id string, item_id long").repartition(3)


def catalogue(spark, items=23):
    return spark.createDataFrame([(i,) for i in range(items)] * 2, "item_id long")


@pytest.mark.parametrize("size", [1, 7, 22, 23, 40])
def test_ring_slices(spark, size):
    found = {}
    for r in frozen.ring_sample(case_table(spark), catalogue(spark), size, 5, "d").collect():
        found.setdefault(r.row_id, []).append(r.item_id)
    assert found.keys() == {f"test|u{k}|{k % 23}" for k in range(60)}
    for row_id, items in found.items():
        assert sorted(items) == sorted(slow_slice(range(23), int(row_id.split("|")[2]), size, 5, "d", row_id))


def test_freeze_resolve_tamper_fail(spark, tmp_path):
    cases = case_table(spark)
    lists = frozen.listed(frozen.ring_sample(cases, catalogue(spark), 7), cases)
    folder = str(tmp_path / "frozen")
    manifest = frozen.freeze(lists, folder, 7, buckets=4, facts={"seed": 0})
    assert manifest["rows"] == 60 and manifest["seed"] == 0
    with pytest.raises(FileExistsError):
        frozen.freeze(lists, folder, 7)
    asked = cases.selectExpr("row_id", "cast(item_id AS string) AS target_item", "1 AS extra")
    found = frozen.resolve(asked, folder, manifest["sha256"])
    assert {r.row_id: r.candidate_items for r in found.collect()} == {r.row_id: r.candidate_items for r in lists.collect()} and found.columns == ["row_id", "target_item", "extra", "candidate_items"]
    sizes = sorted((r["batch"], r["count"]) for r in frozen.batches(found, 25, ["row_id"]).groupBy("batch").count().collect())
    assert sizes == [(0, 25), (1, 25), (2, 10)]
    opened, _ = frozen.opened(spark, folder)
    plan = opened.groupBy("row_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # its buckets serve a grouping or join by row_id
    with pytest.raises(ValueError, match="and not"):
        frozen.opened(spark, folder, "another digest")
    for wrong in (asked.selectExpr("row_id", "'x' AS target_item"), asked.selectExpr("concat(row_id, '!') AS row_id", "target_item")):
        with pytest.raises(ValueError, match="no list, or another"):
            frozen.resolve(wrong, folder)
    other = frozen.listed(frozen.ring_sample(cases, catalogue(spark), 7, seed=1), cases)
    frozen.freeze(other, str(tmp_path / "other"), 7, buckets=4)
    (tmp_path / "frozen" / "candidates").rename(tmp_path / "gone")
    (tmp_path / "other" / "candidates").rename(tmp_path / "frozen" / "candidates")
    with pytest.raises(ValueError, match="its manifest"):
        frozen.resolve(asked, folder)
    with pytest.raises(ValueError, match="are not of size 8"):
        frozen.freeze(lists, str(tmp_path / "third"), 8)
    with pytest.raises(ValueError, match="lack their target"):
        frozen.freeze(lists.selectExpr("row_id", "'none' AS target_item", "candidate_items"), str(tmp_path / "third"), 7)
    with pytest.raises(ValueError, match="row ids repeat"):
        frozen.freeze(lists.union(lists.limit(1)), str(tmp_path / "third"), 7)


def test_a_digest_is_of_rows_in_order_and_not_of_partitions(spark):
    rows = [(f"r{k:05}", k) for k in range(9000)]
    frame = spark.createDataFrame(rows, "row_id string, x long")
    one, two = (frozen.ordered_digest(frame.repartition(n), ["row_id"]) for n in (1, 7))
    assert one == two and one["rows"] == 9000
    swapped = spark.createDataFrame([(r, {17: 18, 18: 17}.get(k, k)) for r, k in rows], "row_id string, x long")
    assert frozen.ordered_digest(swapped, ["row_id"])["sha256"] != one["sha256"]
    assert frozen.ordered_digest(frame, ["x"])["sha256"] == one["sha256"] and frozen.ordered_digest(frame.selectExpr("row_id", "-x AS x"), ["x"])["sha256"] != one["sha256"]
    assert frozen.ordered_digest(frame.where("false"), ["row_id"])["rows"] == 0
    assert frozen.planned({"b": {"size": 7, "seed": 1}}, "/f")["datasets"]["b"]["candidates"] == "/f/b/candidates"


def slow_core(rows, user_k, item_k):
    while True:
        users, items = {}, {}
        for u, i, d in rows:
            users[u] = users.get(u, 0) + 1
            items[d, i] = items.get((d, i), 0) + 1
        kept = [(u, i, d) for u, i, d in rows if users[u] >= user_k and items[d, i] >= item_k]
        if len(kept) == len(rows):
            return sorted(kept)
        rows = kept


@pytest.mark.parametrize("seed", [1, 2])
def test_core_by_deltas_equals_the_recount(spark, seed):
    rng = random.Random(seed)
    rows = [(int(rng.paretovariate(1.1)) % 60, int(rng.paretovariate(0.9)) % 40, rng.choice("ab")) for _ in range(700)]
    frame = spark.createDataFrame(rows, "user_id long, item_id long, domain string")
    kept, report = prep.core_by_deltas(frame.union(spark.createDataFrame([(None, 1, "a"), (1, None, "a")], frame.schema)), 3, 4, "domain")
    assert sorted(map(tuple, kept.collect())) == slow_core(rows, 3, 4) and kept.columns == frame.columns
    rounds = report.orderBy("round").collect()
    assert len(rows) - sum(r.rows for r in rounds) == kept.count() and len(rounds) > 1 and rounds[0].rows > rounds[-1].rows
    whole, _ = prep.core_by_deltas(frame, 3, 4)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, prep.k_core(frame, 3, 4).collect()))
    assert prep.core_by_deltas(frame.where("false"), 3, 4)[0].count() == 0 and prep.core_by_deltas(frame, 900, 900)[0].count() == 0
