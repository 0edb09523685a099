"""Quantile sketches against the values themselves."""

from __future__ import annotations

import math
import random

import pytest

from tideloom.operators import sketch


def test_merged_halves_equal_the_whole_within_the_error(spark):
    rng = random.Random(2)
    rows = [(g, rng.lognormvariate(3, 2) if rng.random() > 0.02 else 0.0) for g in "ab" for _ in range(1500)] + [("c", 5.0), ("a", None)]
    frame = spark.createDataFrame(rows, "g string, x double").repartition(4)
    whole = sketch.sketch(frame, ["g"], "x", 0.02)
    half = sketch.merge(*[sketch.sketch(frame.where(w), ["g"], "x", 0.02) for w in ("x < 20", "x >= 20")])
    key = lambda f: sorted((r.g, r.bucket, r.n, round(r.total, 6)) for r in f.collect())
    assert key(whole) == key(half) and whole.count() < 700
    asked = [0.0, 0.01, 0.5, 0.95, 0.99, 1.0]
    for r in sketch.quantiles(half, ["g"], asked, 0.02).collect():
        values = sorted(x for g, x in rows if g == r.g and x is not None)
        exact = values[max(1, math.ceil(r.quantile * len(values))) - 1]
        assert abs(r.estimate - exact) <= 0.02 * exact + 1e-9
    means = {r.g: (r.requests, r["mean"]) for r in sketch.summary(half, ["g"], 0.02).collect()}
    assert means["c"] == (1, 5.0) and means["a"][1] == pytest.approx(sum(x for g, x in rows if g == "a" and x is not None) / 1500)
    assert sketch.summary(sketch.sketch(frame, [], "x", 0.02), [], 0.02).first().requests == 3001
    assert sketch.quantiles(whole.where("false"), ["g"], asked, 0.02).count() == 0
    with pytest.raises(ValueError, match="between 0 and 1"):
        sketch.sketch(frame, [], "x", 1.5)
