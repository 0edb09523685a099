"""Hand-computed cases and comparisons with plain Python models."""

from __future__ import annotations

import datetime
import hashlib
import json
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tideloom.operators import asof, graph, metrics, models, perturb, prep, prompts, rank, runs, semantic, sequences, splits
from tideloom.sources import sinks, tables

DAY = 86_400
EVENT = "event_id long, user_id long, item_id long, ts long"


def rows(spark, data, schema=EVENT):
    return spark.createDataFrame(data, schema)


def test_six_events_graph(spark):
    events = rows(spark, [(0, 0, 1, 0), (1, 0, 2, DAY), (2, 1, 1, 0), (3, 1, 2, DAY), (4, 2, 2, 0), (5, 2, 1, DAY)])
    edges = {(r.source_id, r.target_id): r for r in graph.tdig_edges(graph.transitions(events)).collect()}
    assert edges[1, 2].support == 2 and edges[2, 1].support == 1
    assert edges[1, 2].lift == pytest.approx(1.5) and edges[1, 2].pmi == pytest.approx(0.405465, abs=1e-6)
    assert edges[1, 2].direction_asymmetry == pytest.approx(1 / 3) and edges[2, 1].direction_asymmetry == pytest.approx(-1 / 3)
    assert edges[1, 2].gap_within_1d == 2


def test_ties_are_skipped_and_lead_on(spark):
    events = rows(spark, [(0, 1, 1, 100), (1, 1, 2, 100), (2, 1, 3, 200)])
    assert [(r.source_id, r.target_id) for r in graph.transitions(events).collect()] == [(2, 3)]
    assert len(graph.transitions(events, include_ties=True).collect()) == 2
    assert graph.strict_transitions(events).collect() == []
    assert tuple(graph.tie_skips(events).first()) == (1, 1, 1)


@pytest.mark.parametrize("seed", range(3))
def test_strict_rule_equals_a_replay(spark, seed):
    rng = random.Random(seed)
    data = [(i, rng.randrange(4), rng.randrange(6), rng.randrange(12)) for i in range(120)]
    expected = []
    for user in range(4):
        last, tied = None, False
        for e, _, item, ts in sorted((r for r in data if r[1] == user), key=lambda r: (r[3], r[0])):
            if last and last[1] == ts:
                tied = True
            else:
                if last and not tied:
                    expected.append((user, last[0], item, last[1], ts))
                tied = False
            last = (item, ts)
    found = graph.strict_transitions(rows(spark, data)).select("user_id", "source_id", "target_id", "source_ts", "target_ts")
    assert sorted(map(tuple, found.collect())) == sorted(expected)


@pytest.mark.parametrize("directed", [True, False])
def test_window_edges_equal_all_pairs(spark, directed):
    rng = random.Random(5)
    data = [(i, rng.randrange(3), rng.randrange(5), rng.randrange(400)) for i in range(90)]
    expected: dict = {}
    for a in data:
        for b in data:
            if a[1] == b[1] and (a[3], a[0]) < (b[3], b[0]) and b[3] - a[3] <= 60:
                key = (a[2], b[2]) if directed or str(a[2]) <= str(b[2]) else (b[2], a[2])
                n, w = expected.get(key, (0, 0.0))
                expected[key] = (n + 1, w + 0.5 ** ((b[3] - a[3]) / 30))
    found = {(r.source_id, r.target_id): (r["count"], r.weight) for r in graph.window_edges(rows(spark, data), 60, directed, 30.0).collect()}
    assert found.keys() == expected.keys()
    assert all(found[k][0] == expected[k][0] and found[k][1] == pytest.approx(expected[k][1]) for k in expected)


def test_k_core_reaches_the_fixpoint(spark):
    rng = random.Random(2)
    data = {(rng.randrange(12), rng.randrange(15)) for _ in range(90)}
    left = set(data)
    while True:
        users = {u for u in {x[0] for x in left} if sum(x[0] == u for x in left) >= 4}
        some = {x for x in left if x[0] in users}
        items = {i for i in {x[1] for x in some} if sum(x[1] == i for x in some) >= 4}
        after = {x for x in some if x[1] in items}
        if after == left:
            break
        left = after
    frame = rows(spark, [(u, i) for u, i in data], "user_id long, item_id long")
    assert {tuple(r) for r in prep.k_core(frame, 4, 4, error_when_empty=False).collect()} == left
    assert {tuple(r) for r in prep.k_core(frame, 4, 4, simultaneous=True, error_when_empty=False).collect()} == left
    with pytest.raises(ValueError):
        prep.k_core(frame, 99, 99)


def test_split_needs_three_events(spark):
    with pytest.raises(PySparkException):
        splits.leave_one_out(rows(spark, [(0, 1, 1, 1), (1, 1, 2, 2)])).collect()


def test_global_cut_sends_ties_later(spark):
    found = splits.global_time(rows(spark, [(i, 1, i, t) for i, t in enumerate([1, 1, 1, 1, 1, 1, 1, 2, 2, 3])]))
    labels = {r.ts: r.split for r in found.collect()}
    assert labels == {1: "train", 2: "val", 3: "test"}


@pytest.mark.parametrize(("gap", "label"), [(1800, "same_session"), (1801, "within_1d"), (DAY, "within_1d"), (DAY + 1, "within_1w"), (7 * DAY, "within_1w"), (30 * DAY, "within_1m"), (30 * DAY + 1, "long_gap")])
def test_gap_bounds(spark, gap, label):
    from pyspark.sql import functions as F

    assert spark.range(1).select(sequences.gap_bucket(F.lit(gap))).first()[0] == label


def test_asof_popularity_is_strict(spark):
    train = rows(spark, [(0, 1, 7, 10), (1, 2, 7, 20), (2, 3, 8, 5)])
    cases = rows(spark, [(10, 9, 7, 20), (11, 9, 7, 21), (12, 9, 8, 1), (13, 9, 99, 50)])
    assert {r.event_id: r.popularity for r in asof.popularity(cases, train).collect()} == {10: 1, 11: 2, 12: 0, 13: 0}


def test_full_rank_counts_the_zero_tail(spark):
    items = rows(spark, [(i,) for i in range(10)], "item_id long")
    cases = rows(spark, [(1, 1, 6, 100), (2, 1, 3, 100)])
    scores = spark.createDataFrame([(1, 9, 2.0), (1, 2, 1.0), (2, 3, 5.0)], "event_id long, candidate_id long, score double")
    seen = rows(spark, [(1, 0), (1, 4)], "event_id long, item_id long")
    assert {r.event_id: r["rank"] for r in asof.full_rank(cases, scores, items, seen).collect()} == {1: 6, 2: 1}


def test_metrics_by_hand(spark):
    ranks = spark.createDataFrame([(1,), (3,), (None,)], "rank int")
    row = metrics.ranking(ranks, (2, 5)).first()
    assert row.hr_2 == pytest.approx(1 / 3) and row.hr_5 == pytest.approx(2 / 3)
    assert row.ndcg_5 == pytest.approx((1 + 1 / math.log2(4)) / 3) and row.mrr_5 == pytest.approx((1 + 1 / 3) / 3)


def test_token_rules(spark):
    index = semantic.token_index(spark.createDataFrame([(1, "The Red-Box 2 of x 99 b4")], "item_id long, t string"), ["t"])
    assert {r.token for r in index.collect()} == {"red", "box", "b4"}


@pytest.mark.parametrize(
    ("text", "ranked", "invalid"),
    [('```json\n{"ranked_items": ["b", "x", "b"]}\n```', ["b"], ["x"]), ('noise {"ranked_items": ["a", {"item_id": "c"}]} {', ["a", "c"], []), ("nothing", [], []), (None, [], [])],
)
def test_answers(text, ranked, invalid):
    found = prompts.parse_answer(text, ["a", "b", "c"])
    assert found["ranked"] == ranked and found["invalid"] == invalid and found["parse_success"] == bool(ranked)


def test_ids_and_ties(spark):
    frame = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "k string")
    assert {r.k: r.i for r in prep.dense_ids(frame, "k", "i").collect()} == {"a": 0, "b": 1, "c": 2}


@pytest.mark.parametrize("block_pairs", [1000, 12])
def test_factors_learn_and_rank(spark, block_pairs):
    pairs = [(u, 100 + i) for u in range(12) for i in range(12) if (u < 6) == (i < 6) and u != i]
    frame = spark.createDataFrame(pairs, "user long, item long")
    trials = [{"factors": 4, "epochs": e, "rate": 0.2, "decay": 0.001, "seed": 1} for e in (12, 1)]
    factors = models.sweep(frame, trials, block_pairs=block_pairs, batch=8).cache()
    side = {(r.trial, r.kind, r.id): (np.array(r.vector), r.bias) for r in factors.collect()}
    assert len(side) == 2 * 24
    value = {(t, u, i): float(side[t, "user", u][0] @ side[t, "item", i][0] + side[t, "item", i][1]) for t in (0, 1) for u in range(12) for i in range(100, 112)}
    near = [v for (t, u, i), v in value.items() if t == 0 and (u < 6) == (i < 106)]
    far = [v for (t, u, i), v in value.items() if t == 0 and (u < 6) != (i < 106)]
    assert np.mean(near) > np.mean(far) + 0.5
    cases = [(t, 50 + u, u, 100 + u) for t in (0, 1) for u in range(12)]
    ranks = models.target_ranks(factors, spark.createDataFrame(cases, "trial int, case_id long, user long, item long"), frame, case_block=5, item_block=4).collect()
    seen = set(pairs)
    order = {(t, u): sorted((i for i in range(100, 112) if (u, i) not in seen), key=lambda i: (-value[t, u, i], i)) for t in (0, 1) for u in range(12)}
    assert {(r.trial, r.user): r["rank"] for r in ranks} == {(t, u): order[t, u].index(100 + u) + 1 for t, u in order}
    best = models.top_unseen(factors, spark.createDataFrame(cases, "trial int, case_id long, user long, item long"), frame, 3, case_block=5, item_block=4).collect()
    assert {(r.trial, r.user, r["rank"]): r["item"] for r in best} == {(t, u, n + 1): i for (t, u), found in order.items() for n, i in enumerate(found[:3])}


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "ratings.dat").write_text("1::10::4.0::100\n2::11::3.5::200\n", encoding="latin-1")
    assert tables.read_ratings(spark, str(tmp_path / "ratings.dat")).count() == 2
    frame = spark.createDataFrame([(1, "a,b\"c"), (2, None)], "x long, y string")
    sinks.write_jsonl(frame, str(tmp_path / "j.jsonl"))
    assert sorted(map(tuple, tables.read_records(spark, str(tmp_path / "j.jsonl")).select("x", "y").collect())) == [(1, "a,b\"c"), (2, None)]
    sinks.write_csv(frame, str(tmp_path / "c.csv"))
    assert tables.read_records(spark, str(tmp_path / "c.csv")).count() == 2
    assert sinks.write_manifest(frame, str(tmp_path / "m"))["rows"] == 2
    assert tables.choose_file(["b.jsonl.gz", "meta_b.jsonl", "a.jsonl"], metadata=False) == "a.jsonl"


def test_normalising_drops_with_reasons(spark):
    raw = spark.createDataFrame([("u", "", "i", "1700000000000"), (None, "p", "i", "5"), ("u", "p", "i", "x")], "user string, parent string, item string, ts string")
    found = prep.normalize_interactions(raw, ("user",), ("parent", "item"), ("ts",))
    assert [tuple(r) for r in found.collect()] == [("u", "i", 1_700_000_000, 1.0, None), (None, "p", 5, 1.0, "missing_user"), ("u", "p", None, 1.0, "missing_timestamp")]


def test_times_are_swapped_by_ordinal(spark):
    history = spark.createDataFrame([(1, 100 * DAY, t, i, i) for i, t in enumerate([10 * DAY, 20 * DAY, 80 * DAY, 95 * DAY])], "case_id long, case_ts long, ts long, event_id long, item_id long")
    found = {r.item_id: r.swapped_ts // DAY for r in perturb.swap_far_and_near(history).collect()}
    assert found == {0: 95, 1: 20, 2: 80, 3: 10}
    dealt = perturb.random_times(history, 1).collect()
    assert sorted(r.ts for r in dealt) == sorted(r.ts for r in history.collect()) and len(dealt) == 4


def test_variants_of_a_history(spark):
    frame = spark.createDataFrame([(1, list(range(8)))], "user_id long, items array<long>")
    found = {r.variant: list(r["items"]) for r in perturb.variants(frame, recent=3).collect()}
    assert found["reversed"] == list(range(7, -1, -1)) and found["recent_3"] == [5, 6, 7] and found["remove_recent_3"] == [0, 1, 2, 3, 4]
    assert sorted(found["shuffled_seed_0"]) == list(range(8))


def test_batches_fit_the_memory():
    assert runs.fitting_batch(512, 1000, "float32", 512) == 512 and runs.fitting_batch(512, 1_000_000, "float32", 512) == 134
    with pytest.raises(MemoryError):
        runs.fitting_batch(1, 1_000_000, "float64", 1)


def test_popularity_rank_equals_the_full_ranking(spark):
    rng = random.Random(1)
    items = rows(spark, [(i,) for i in range(30)], "item_id long")
    counts = {i: float(rng.randrange(4)) for i in range(25)}
    cases = [(e, 1, rng.randrange(30), 9) for e in range(12)]
    seen = {(e, rng.randrange(30)) for e in range(12) for _ in range(6)}
    found = {r.event_id: r["rank"] for r in asof.popularity_rank(rows(spark, cases), spark.createDataFrame(list(counts.items()), "item_id long, score double"), items, rows(spark, list(seen), "event_id long, item_id long")).collect()}
    for e, _, target, _ in cases:
        open_items = [i for i in range(30) if i == target or (e, i) not in seen]
        assert found[e] == 1 + sorted(open_items, key=lambda i: (-counts.get(i, 0.0), i)).index(target)


def test_dot_products_search_every_item(spark, tmp_path):
    from tideloom.plans import registry

    vectors = np.random.default_rng(3).normal(size=(1400, 8))
    frame = spark.createDataFrame([(i, int(i >= 20), v.tolist()) for i, v in enumerate(vectors)], "vec_id long, label int, embedding array<double>")
    frame.write.parquet(f"{tmp_path}/embeddings.parquet")
    asked = list(range(0, 1400, 50))
    queries, items = frame.where("vec_id % 50 = 0").selectExpr("vec_id AS query_id", "embedding AS vector"), frame.selectExpr("vec_id AS item_id", "embedding AS vector")
    scores = np.round(vectors[asked] @ vectors.T, 6)
    scores[range(len(asked)), asked] = -np.inf
    truth = sorted((q, int(i), n + 1) for r, q in enumerate(asked) for n, i in enumerate(np.lexsort((np.arange(1400), -scores[r]))[:5]))
    for found in (registry.queries()["dot_product_topk"](spark, str(tmp_path)), rank.dot_top_k(queries, items, 5, 7, 100)):
        assert sorted((r.query_id, r.item_id, r["rank"]) for r in found.collect()) == truth


def test_hard_negatives_read_every_item(spark):
    rng = random.Random(6)
    cases = [(e, e, rng.randrange(1500), 9) for e in range(6)]
    seen = {(e, rng.randrange(1500)) for e in range(6) for _ in range(30)} | {(0, i) for i in range(1490, 1500)}
    overlap = {(e, rng.randrange(1500)): rng.randrange(1, 4) for e in range(6) for _ in range(40)}
    moved = {(e, rng.randrange(1500)): (rng.randrange(1, 5) / 8, 1) for e in range(6) for _ in range(40)}
    counts = {i: 1 + i // 3 for i in range(1500) if i % 7}
    keyed = lambda pairs: [(*k, *(v if isinstance(v, tuple) else (v,))) for k, v in pairs.items()]
    found = semantic.hard_negatives(
        rows(spark, cases),
        spark.range(1500).withColumnRenamed("id", "item_id"),
        rows(spark, list(seen), "event_id long, item_id long"),
        rows(spark, keyed(overlap), "event_id long, item_id long, overlap long"),
        rows(spark, keyed(moved), "event_id long, item_id long, score double, support long"),
        rows(spark, list(counts.items()), "item_id long, popularity long"),
    ).collect()
    truth = set()
    for e, _, target, _ in cases:
        items = [i for i in range(1500) if i != target and (e, i) not in seen]
        o, (s, n), p = (lambda i, e=e: overlap.get((e, i), 0)), ((lambda i, e=e, at=at: moved.get((e, i), (0, 0))[at]) for at in (0, 1)), lambda i: counts.get(i, 0)
        close, next_to = [i for i in items if o(i)], [i for i in items if s(i)]
        drawn = min(items, key=lambda i, e=e: (int(hashlib.sha256(f"0|{e}|{i}".encode()).hexdigest()[:12], 16), i))
        truth.add((e, min(close, key=lambda i: (-o(i), n(i) > 0, s(i), -p(i), i)), min(next_to, key=lambda i: (-s(i), o(i), -n(i), i)), min(items, key=lambda i: (-p(i), i)), drawn))
    assert {tuple(r) for r in found} == truth


@pytest.mark.parametrize("name", ["random_rank", "evidence_scores", "window_rank_topk", "hard_negatives"])
def test_more_than_a_thousand_items_equal_the_sql(spark, tmp_path, name):
    from tideloom.plans import registry

    rng, start = random.Random(7), datetime.datetime(2024, 1, 1)
    events = [(e, start + datetime.timedelta(hours=5 * e), e % 5, "view", 1.0, json.dumps({"k": rng.randrange(1400)})) for e in range(2600)]
    parts = [(i, f"cold widget n{i % 90}", f"Brand#{i % 7}", f"type {i % 4}", 1) for i in range(1400)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    duck = duckdb.connect()
    for table in ("events", "part"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    answer = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in answer.description]
    found = registry.queries()[name](spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(repr, (tuple(r) for r in found))) == sorted(map(repr, answer.fetchall()))


def test_resampling_takes_a_thousand_rounds(spark):
    from tideloom.plans import registry

    found = [r.p_randomization * 1001 for r in registry.queries()["paired_resampling"](spark, "/root/testdata/sf0.001").collect()]
    assert found and found == pytest.approx([round(p) for p in found], abs=1e-6)


def test_resampling_equals_brute_force(spark):
    import struct

    import xxhash

    from tideloom.operators import stats

    rng = random.Random(3)
    rows = [(g, rng.randrange(1 << 60), rng.random(), rng.random()) for g in ("x", "y") for _ in range(30)]
    found = {r.g: r for r in stats.resampled(spark.createDataFrame(rows, "g string, row long, a double, b double"), ["g"], rounds=40, seed=5).collect()}
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])
    for g in ("x", "y"):
        mine = [(row, a - b) for name, row, a, b in rows if name == g]
        flips, means = [], []
        for r in range(40):
            flip = boot = weight = 0.0
            for row, d in mine:
                h = 42
                for v in (5, r, row):
                    h = xxhash.xxh64_intdigest(struct.pack("<q", v), h)
                w = int(np.searchsorted(steps, (h >> 11) / 2**53, side="right"))
                flip, boot, weight = flip + (d if h & 1 else -d), boot + w * d, weight + w
            flips.append(flip), means.append(boot / weight)
        total = abs(sum(d for _, d in mine))
        assert found[g].p_randomization == pytest.approx((1 + sum(abs(f) >= total - 1e-12 for f in flips)) / 41)
        assert (found[g].ci_low, found[g].ci_high) == pytest.approx((np.quantile(means, 0.025), np.quantile(means, 0.975)))


def test_t_values_and_p(spark):
    from tideloom.operators import stats

    rows = [("a", 1.0, 0.0), ("a", 2.0, 1.5), ("a", 3.0, 2.9), ("b", 1.0, 1.0), ("c", 2.0, 1.0), ("c", 3.0, 2.0)]
    found = {r.g: r for r in stats.paired_t_test(spark.createDataFrame(rows, "g string, a double, b double"), ["g"]).collect()}
    d = np.array([1.0, 0.5, 0.1])
    t = d.mean() / math.sqrt(d.var(ddof=1) / 3)
    assert found["a"].t == pytest.approx(t) and found["a"].p_value == pytest.approx(math.erfc(t / math.sqrt(2)))
    assert found["b"].p_value == 1.0 and found["b"].direction == "tied" and found["c"].p_value == 0.0 and found["c"].direction == "improved"


def test_numbers_are_printed_as_printf_does(spark):
    from tideloom.operators import evidence, prompts

    rng = random.Random(1)
    values = [0.0, 1.0, 0.5, 9999.6, 9999.4, 12345.0, 12355.0, 99995.0, 0.00012345, 999.95, 999.949, 1e10, -3.5, 0.99996] + [10 ** rng.uniform(-4, 12) for _ in range(300)] + [float(rng.randrange(10**6)) for _ in range(300)]
    for r in spark.createDataFrame([(v,) for v in values], "v double").withColumn("s", evidence.short_number(F.col("v"))).collect():
        assert r.s == f"{r.v:.4g}"
    gaps = [4140, 4500, 3599, 86_399, 1_234_567_890] + [rng.randrange(10**6) for _ in range(300)]
    for r in spark.createDataFrame([(v,) for v in gaps], "v long").withColumn("s", prompts.human_gap(F.col("v"))).collect():
        assert r.s == (f"{r.v:.0f} seconds" if r.v < 3600 else f"{r.v / 3600:.1f} hours" if r.v < 86_400 else f"{r.v / 86_400:.1f} days")


@pytest.mark.parametrize("seed", range(2))
def test_last_distinct_items_before_a_case(spark, seed):
    from tideloom.operators import asof

    rng = random.Random(seed)
    events = [(e, rng.randrange(4), rng.randrange(6), rng.randrange(30)) for e in range(80)]
    cases = [(100 + c, rng.randrange(5), rng.randrange(6), rng.randrange(32)) for c in range(25)]
    schema = "event_id long, user_id long, item_id long, ts long"
    found = asof.sources_of(spark.createDataFrame(cases, schema), spark.createDataFrame(events, schema), 3).collect()
    expected = set()
    for case, user, _, ts in cases:
        latest = {}
        for e, u, i, t in events:
            if u == user and t < ts:
                latest[i] = max(latest.get(i, (-1, -1)), (t, e))
        expected |= {(case, i, n + 1) for n, i in enumerate(sorted(latest, key=latest.get, reverse=True)[:3])}
    assert {tuple(r) for r in found} == expected


def test_last_items_where_both_sides_lie_by_user(spark):
    """Cases and events come from windows by user, whose partitions Spark coalesces by their sizes."""
    from tideloom.operators import asof, splits

    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b"}
    before = {k: spark.conf.get(k) for k in settings}
    labelled = splits.leave_one_out(spark.range(6_000).selectExpr("id AS event_id", "id % 200 AS user_id", "crc32(string(id)) % 9 AS item_id", "id div 200 AS ts"))
    odd = labelled.limit(0).union(spark.createDataFrame([(-1, None, 1, 3, "train"), (-2, 7, 1, None, "train")], labelled.schema))
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        cases = labelled.where("split = 'test'").select("event_id", "user_id", "ts")
        found = {tuple(r) for r in asof.sources_of(cases, labelled.where("split <> 'test'"), 3).collect()}
        with_odd = {tuple(r) for r in asof.sources_of(cases.union(odd.select("event_id", "user_id", "ts")), labelled.where("split <> 'test'").union(odd), 3).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    rows, expected = labelled.collect(), set()
    for case in (r for r in rows if r.split == "test"):
        latest = {}
        for r in rows:
            if r.user_id == case.user_id and r.ts < case.ts:
                latest[r.item_id] = max(latest.get(r.item_id, -1), r.ts)
        expected |= {(case.event_id, i, n + 1) for n, i in enumerate(sorted(latest, key=latest.get, reverse=True)[:3])}
    assert found == expected and len(found) == 600
    assert with_odd == expected


def test_late_rows_are_left_out_of_a_stream(spark, tmp_path):
    from tideloom.streaming import transitions as streams

    def rows(name, times):
        spark.createDataFrame([(t, 1) for t in times], "ts long, item_id long").selectExpr("timestamp_seconds(ts) AS event_time", "item_id").coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    def run():
        read = spark.readStream.schema("event_time timestamp, item_id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        query = streams.stream_popularity(read, "1 day", "1 hour").writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()

    day = 86_400
    for name, times in (("a", [10, 20]), ("b", [3 * day]), ("c", [30, 3 * day + 1]), ("d", [6 * day])):
        rows(name, times)
        run()
    found = spark.read.parquet(f"{tmp_path}/out").selectExpr("unix_seconds(window_start) AS s", "count").collect()
    assert sorted(map(tuple, found)) == [(0, 2), (3 * day, 2)]  # the row of second 30 came after its day had closed


REF = "struct<artifact_id:string,artifact_path:string,artifact_sha256:string,candidate_row_id:string,candidate_size:string>"
PREDICTION = f"user_id string, target_item string, predicted_items array<string>, candidate_items array<string>, candidate_ref {REF}, scores array<double>"


def test_checks_of_predictions(spark):
    from tideloom.operators import checks

    ref = ("a", "p", "s", "r", "20")
    cases = [
        (("u", "t", ["a"], ["a", "t"], None, [0.5]), None),
        (("u", "t", [], None, ref, None), None),
        (("", "t", ["a"], ["a"], None, None), "missing required field: user_id"),
        (("u", None, ["a"], ["a"], None, None), "missing required field: target_item"),
        (("u", "t", ["a", None], ["a"], None, None), "predicted_items must be a list of strings"),
        (("u", "t", ["a"], [None], None, None), "candidate_items must be a list of strings"),
        (("u", "t", ["a"], None, None, None), "candidate_items or candidate_ref must be present"),
        (("u", "t", ["a"], ["a"], None, [0.1, 0.2]), "scores must be empty or as many as predicted_items"),
        (("u", "t", ["a"], ["a"], None, [None]), "scores must be numbers"),
        (("u", "t", ["a"], None, ("a", "p", None, "r", "20"), None), "candidate_ref has empty field: artifact_sha256"),
        (("u", "t", ["a"], None, ("a", "p", "s", "r", "x"), None), "candidate_ref.candidate_size must be int"),
        (("u", "t", ["a"], None, ("a", "p", "s", "r", "-1"), None), "candidate_ref.candidate_size must be positive"),
    ]
    for row, problem in cases:
        found = checks.checked_predictions(spark.createDataFrame([row], PREDICTION), "sampled").first()
        assert found.problem == problem and found.method == "unknown" and found.scores is not None
    bare = spark.createDataFrame([("u", "t", ["a"], None, None, None)], PREDICTION)
    assert checks.checked_predictions(bare, "no_candidates").first().problem is None
    assert checks.valid_predictions(bare, "no_candidates").count() == 1
    with pytest.raises(PySparkException):
        checks.valid_predictions(bare, "sampled").collect()
    with pytest.raises(ValueError, match="rows lacks scores"):
        checks.require_fields(bare.drop("scores"), ["scores", "user_id"], "rows")


def test_accumulated_metrics_by_hand(spark):
    from tideloom.operators import evaluate

    rows = [("m", "1", ["3", "3", "1"], ["1", "3"]), ("m", "9", ["1", "77"], []), ("n", "2", [], [])]
    train = spark.createDataFrame([(1,), (1,), (1,), (2,), (3,)], "item_id long")
    items = spark.createDataFrame([(i,) for i in range(1, 11)], "item_id long")
    found = {r.method: r for r in evaluate.accumulated(spark.createDataFrame(rows, "method string, target_item string, predicted_items array<string>, candidate_items array<string>"), items, train, [["method"]]).collect()}
    m = found["m"]
    assert (m.num_predictions, m.recall_1, m.recall_5, m.mrr_5) == (2, 0.0, 0.5, 0.25) and m.ndcg_5 == pytest.approx(0.5 / math.log2(3))
    assert m.item_coverage == 2 and m.coverage == 0.2 and m.hallucination_rate == 0.2 and m.long_tail_ratio == 0.0
    assert m.novelty == pytest.approx(-np.mean([math.log2(x / 9) for x in (2, 2, 4, 4, 1)]))
    assert (found["n"].recall_10, found["n"].item_coverage, found["n"].validity_rate) == (0.0, 0, 1.0)


def test_runs_are_written_locked_and_resumed(spark, tmp_path, capsys):
    from tideloom.__main__ import main
    from tideloom.operators import protocol
    from tideloom.plans import matrix

    config = {"methods": ["popularity", "nonsense", "random"], "seeds": [0, 1], "top": 5}
    found = matrix.run(spark, config, "/root/testdata/sf0.001", f"{tmp_path}/run")
    assert {(r.method, r.seed) for r in found.collect() if r.seed is not None} == {(m, s) for m in ("popularity", "random") for s in (0, 1)}
    status = spark.read.parquet(f"{tmp_path}/run/status")
    assert {(r.category, r.failures) for r in protocol.failure_counts(status).collect()} == {("runtime_error", 2)}
    assert not protocol.exists(spark, f"{tmp_path}/run/lock")  # a method failed
    assert {len(r.predicted_items) for p in (tmp_path / "run" / "predictions").iterdir() for r in spark.read.parquet(str(p)).collect()} == {5}
    longer = matrix.run(spark, {"methods": ["popularity", "markov"], "top": 10}, "/root/testdata/sf0.001", f"{tmp_path}/run")
    assert {r.method for r in longer.collect() if r.method is not None} == {"popularity", "markov"} and protocol.exists(spark, f"{tmp_path}/run/lock")
    again = sorted(p.name for p in (tmp_path / "run" / "predictions").iterdir())
    matrix.run(spark, {"methods": ["popularity", "markov"], "top": 10}, "/root/testdata/sf0.001", f"{tmp_path}/run")
    assert again == sorted(p.name for p in (tmp_path / "run" / "predictions").iterdir()) and len(again) == 6
    assert sorted({len(r.predicted_items) for p in again for r in spark.read.parquet(f"{tmp_path}/run/predictions/{p}").collect()}) == [5, 10]
    with pytest.raises(ValueError, match="no method of the run succeeded"):
        matrix.run(spark, {"methods": ["nonsense"]}, "/root/testdata/sf0.001", f"{tmp_path}/other")
    for wrong in ({}, {"methods": []}, {"methods": ["markov"], "seeds": ["x"]}, {"methods": ["markov"], "top": 0}):
        with pytest.raises(ValueError, match="must be"):
            matrix.check_config(wrong)
    with pytest.raises(ValueError, match="lacks config"):
        protocol.lock(spark, f"{tmp_path}/none")
    (tmp_path / "config.json").write_text(json.dumps({"methods": ["markov"]}))
    spark.sparkContext.setLogLevel("OFF")
    assert main(["experiment", str(tmp_path / "config.json"), "--input", "/root/testdata/sf0.001", "--output", f"{tmp_path}/run"]) == 0
    assert "markov" in capsys.readouterr().out


def test_manifests_and_ablations(spark, tmp_path):
    from tideloom.operators import protocol

    frame = spark.createDataFrame([(1, "a"), (2, "b")], "x long, y string")
    first = protocol.freeze(spark, str(tmp_path), "v1", {"c": {"methods": ["b", "a"], "seeds": [1]}}, {"t": frame})
    assert first["methods"] == ["a", "b"] and first["tables"]["t"] == protocol.table_digest(frame.orderBy("y", ascending=False))
    with pytest.raises(FileExistsError):
        protocol.freeze(spark, str(tmp_path), "v2", {}, {})
    assert protocol.freeze(spark, str(tmp_path), "v2", {}, {}, force=True)["version"] == "v2"
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.bin").write_bytes(b"abc")
    print_ = protocol.file_fingerprints(spark, f"{tmp_path}/f").first()
    assert print_.bytes == 3 and print_.sha256 == hashlib.sha256(b"abc").hexdigest()
    assert not protocol.ablation("full").use_llm and protocol.ablation("encoder_only").use_dynamic_encoder and not protocol.ablation("w_o_temporal_graph").use_time_gap_tags
    with pytest.raises(ValueError, match="no such ablation"):
        protocol.ablation("w_o_everything")


def test_numbers_of_any_length_sort_by_value(spark):
    labels = ["-1", "-2", "-10", "0", "00", "-0", "5", "05", "40", "9" * 30, "1" + "0" * 30, "-" + "9" * 30, "x", "10a", ""]
    rng = random.Random(1)
    rng.shuffle(labels)
    found = [r.l for r in spark.createDataFrame([(x,) for x in labels], "l string").orderBy(prep.natural_key(F.col("l"))).collect()]
    assert found == sorted(labels, key=lambda x: (0, int(x), x) if re.fullmatch("-?[0-9]+", x) else (1, 0, x))


def test_of_repeated_rows_the_first_stays(spark, tmp_path):
    rows = [("d", "u", "i", 5, float(k), None) for k in range(6, 0, -1)]
    items = spark.createDataFrame([("d", "i", t) for t in ("z", None, "b", "c", "")], "domain string, item_id string, title string")
    schema = "domain string, user_id string, item_id string, ts long, rating double, drop_reason string"
    for parts in (1, 4):
        kept, described, report = prep.convert_domains(spark.createDataFrame(rows, schema).repartition(parts), items.repartition(parts))
        assert [r.rating for r in kept.collect()] == [1.0] and [r.title for r in described.collect()] == ["b"] and report.first().duplicates == 5
    equal = [spark.createDataFrame([(x,), (x,)], "x string") for x in "ab"]
    assert sinks.write_manifest(equal[0], str(tmp_path / "a"))["digest"] != sinks.write_manifest(equal[1], str(tmp_path / "b"))["digest"]
    answers = spark.createDataFrame([("k", "b"), ("k", "a"), ("l", "c")], "cache_key string, text string")
    prompts.store(answers, f"{tmp_path}/store")
    prompts.store(answers, f"{tmp_path}/store")
    assert sorted(map(tuple, prompts.stored(spark, f"{tmp_path}/store").collect())) == [("k", "a"), ("l", "c")]


def test_stored_answers_are_not_asked_again(spark, tmp_path):
    asked = spark.createDataFrame([("k1", "a"), ("k2", "b")], "cache_key string, text string")
    prompts.store(asked.where("cache_key = 'k1'"), f"{tmp_path}/answers")
    assert [r.text for r in prompts.uncached(asked, spark.read.parquet(f"{tmp_path}/answers")).collect()] == ["b"]


def test_archives_and_domains(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as packed:
        packed.writestr("ml/ratings.dat", "1::10::4.0::100\n")
    assert tables.read_ratings(spark, tables.unzip_ratings(str(tmp_path / "a.zip"), str(tmp_path / "out")) + "/ratings.dat").count() == 1
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as packed:
        packed.writestr("readme", "")
    with pytest.raises(FileNotFoundError):
        tables.unzip_ratings(str(tmp_path / "b.zip"), str(tmp_path / "out"))
    (tmp_path / "Books.jsonl").write_text('{"user_id": "u", "asin": "i", "timestamp": 1}\n' * 40)
    (tmp_path / "meta_Books.jsonl").write_text('{"asin": "i", "title": "t"}\n')
    found = tables.inspect_domains(spark, {"Books": [str(tmp_path / "Books.jsonl"), str(tmp_path / "meta_Books.jsonl")], "Toys": []}, {"user": ("user_id",), "item": ("parent_asin", "asin")})
    assert found["domains"]["Books"]["rows"] == 40 and found["domains"]["Books"]["convertible"] == {"user": True, "item": True} and found["status"] == "partial"
    assert prep.timestamp_column(["a", "unixReviewTime"]) == "unixReviewTime"
    with pytest.raises(ValueError, match="no timestamp"):
        prep.timestamp_column(["a"])
    rows = spark.createDataFrame([([" a ", "", "b"], "m"), ([], "m"), (None, " ")], "categories array<string>, main_category string")
    assert [r[0] for r in rows.select(prep.category_text(dict(rows.dtypes))).collect()] == ["a b", "m", None]


def test_command_line_lists_queries(capsys):
    from tideloom.__main__ import main

    assert main(["list"]) == 0 and "tdig_edges" in capsys.readouterr().out.split()


@pytest.mark.parametrize("block", [16_000_000, 300])
def test_bm25_equals_its_sql_on_odd_rows(spark, tmp_path, block):
    """Repeated and null ids, null and empty texts, many equal scores, in one block and in many."""
    import duckdb

    from tideloom.operators import rank
    from tideloom.plans import registry

    rng = random.Random(block)
    docs = [(i // 2 if i < 12 else i, " ".join(rng.choice("Ab b! c d-e f1 g".split()) for _ in range(rng.randrange(1, 9)))) for i in range(90)]
    docs += [(i, "a same text") for i in range(200, 230)] + [(None, "a b c"), (None, "c"), (300, None), (301, ""), (3, None)]
    asked = [(1, "a b b"), (2, "same c"), (3, "nothing here"), (4, "e f1"), (5, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    queries, documents = (spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("benchmark", "documents"))
    found = rank.bm25_top_k(queries.withColumnRenamed("item_id", "query_id"), documents, 10, query_block=2 if block == 300 else 512, block_bytes=block).select("query_id", "doc_id", "score", "rank")
    with duckdb.connect() as link:
        for n in ("benchmark", "documents"):
            link.execute(f"CREATE VIEW {n} AS SELECT * FROM '{tmp_path}/{n}.parquet/*.parquet'")
        expected = sorted(link.execute(registry.oracle_sql()["bm25_topk"]).fetchall())
    assert sorted(map(tuple, found.collect())) == expected and len(expected) >= 30
