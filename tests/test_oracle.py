"""Every query of the engine's own operators against its SQL on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from tideloom.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    link = duckdb.connect()
    for name in TABLES:
        link.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return link


def shown(value) -> str:
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, str | bool):
        return str(value)
    if isinstance(value, int | float) or hasattr(value, "as_tuple"):
        return f"{float(value):.6f}"
    return str(value)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    found = registry.queries()[name](spark, FOLDER)
    answer = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in answer.description]
    assert sorted(found.columns) == sorted(names)
    at = [found.columns.index(c) for c in sorted(names)]
    there = [names.index(c) for c in sorted(names)]
    assert sorted(tuple(shown(r[i]) for i in at) for r in found.collect()) == sorted(tuple(shown(r[i]) for i in there) for r in answer.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert registry.queries()[name](spark, FOLDER).count() > 0
