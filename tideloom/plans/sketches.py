"""Queries: quantile sketches."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tideloom.operators import sketch
from tideloom.plans.base import rounded
from tideloom.plans.registry import register
from tideloom.sources.tables import table

_ERROR = 0.01
_GAMMA = (1 + _ERROR) / (1 - _ERROR)
_SQL = f"""WITH v AS (SELECT role, CAST(CASE WHEN length(text) > 0 THEN ceil(ln(length(text)::DOUBLE) / {math.log(_GAMMA)!r}) ELSE -2147483648 END AS INTEGER) AS bucket, count(*) AS n, sum(length(text))::DOUBLE AS total FROM conversations WHERE text IS NOT NULL GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY role ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY role) AS m FROM v),
q AS (SELECT role, q, min(bucket) AS bucket FROM c, (VALUES (0.5::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE)) x(q) WHERE upto >= greatest(ceil(q * m), 1) GROUP BY ALL),
e AS (SELECT role, q, CASE WHEN bucket > -2147483648 THEN pow({_GAMMA!r}, bucket) * 2 / {_GAMMA + 1!r} ELSE 0 END AS x FROM q)
SELECT role, any_value(s.requests)::BIGINT AS requests, round(any_value(s.mean), 6) AS mean, round(max(x) FILTER (q = 0.5), 6) AS p50, round(max(x) FILTER (q = 0.95), 6) AS p95, round(max(x) FILTER (q = 0.99), 6) AS p99
FROM e JOIN (SELECT role, sum(n) AS requests, sum(total) / sum(n) AS mean FROM v GROUP BY role) s USING (role) GROUP BY role"""


@register("length_sketches", _SQL)
def _(spark, folder):
    """Quantiles of the turns' lengths by role, from two halves that are merged."""
    turns = table(spark, folder, "conversations").select("role", "conv_id", F.length("text").alias("length"))
    halves = [sketch.sketch(turns.where(F.col("conv_id") % 2 == r), ["role"], "length", _ERROR) for r in (0, 1)]
    return rounded(sketch.summary(sketch.merge(*halves), ["role"], _ERROR))
