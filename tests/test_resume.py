"""Training that goes on where it stopped, the best trial, and users that training has not seen."""

from __future__ import annotations

import random

import pytest

from tideloom.operators import models

TRIALS = [{"factors": 3, "epochs": 2, "rate": 0.1, "decay": 0.01, "seed": 1}, {"factors": 2, "epochs": 1, "rate": 0.05, "decay": 0.0, "seed": 2}]


def pair_table(spark, seed=1):
    rng = random.Random(seed)
    return spark.createDataFrame(sorted({(rng.randrange(20), rng.randrange(15)) for _ in range(160)}), "user long, item long").repartition(3)


def shown(factors):
    return sorted((r.trial, r.kind, r.id, tuple(r.vector), r.bias) for r in factors.collect())


def test_stopped_and_resumed_equals_uninterrupted(spark, tmp_path):
    whole = shown(models.sweep(pair_table(spark), TRIALS, block_pairs=40))
    folder = str(tmp_path / "run")
    with pytest.raises(FileNotFoundError):
        models.saved(spark, folder)
    for _ in range(5):  # two blocks of both sides, two epochs: four strata, and a call that finds nothing to do
        part = models.sweep(pair_table(spark).repartition(2), TRIALS, block_pairs=40, folder=folder, most_steps=1)
    assert shown(part) == whole == shown(models.saved(spark, folder))
    assert len([p for p in (tmp_path / "run").iterdir() if p.name.startswith("step=")]) == 2
    (tmp_path / "run" / f"step={max(models._steps_done(spark, folder))}" / "_SUCCESS").unlink()  # as a write that was cut off
    assert shown(models.sweep(pair_table(spark), TRIALS, block_pairs=40, folder=folder)) == whole
    with pytest.raises(ValueError, match="other trials or pairs"):
        models.sweep(pair_table(spark, 2), TRIALS, block_pairs=40, folder=folder)


def test_best_trial_and_cold_users(spark):
    ranks = spark.createDataFrame([(0, 1), (0, None), (1, 2), (1, 2), (2, 2), (2, 2)], "trial int, rank long")
    assert models.best_trial(ranks, "ndcg") == 1 and models.best_trial(ranks, "mrr", 1) == 0 and models.best_trial(ranks, "hr") == 1
    with pytest.raises(ValueError, match="no such measure"):
        models.best_trial(ranks, "auc")
    ranked = spark.createDataFrame([(0, 1, 7, 0.5, 1)], "trial int, user long, item long, score double, rank int")
    cases = spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "trial int, user long")
    popular = spark.createDataFrame([(7, 9.0), (8, 9.0), (9, 5.0), (10, 1.0)], "item long, score double")
    seen = spark.createDataFrame([(2, 7), (2, 9), (2, 7)], "user long, item long")
    found = sorted(map(tuple, models.with_popularity(ranked, cases, popular, seen, 2).collect()))
    assert found == [(0, 1, 7, 0.5, 1), (0, 2, 8, 9.0, 1), (0, 2, 10, 1.0, 2), (0, 3, 7, 9.0, 1), (0, 3, 8, 9.0, 2)]
