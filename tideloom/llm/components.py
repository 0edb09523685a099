"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is an aggregation and a join on narrow rows; no node's neighbourhood is gathered anywhere, so a
hub with many neighbours costs rows and not the memory of one task. Components never reach the driver; it
sees one count and one checksum a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideloom.functions.cuts import cut

SMALL_GRAPH = 250_000  # links that one task joins


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same stars of all edges of one task."""
    least: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := least.setdefault(x, x)) != x:
            least[x] = least[up]
            x = up
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            least[max(a, b)] = min(a, b)
    stars = [(x, root(x)) for x in list(least)]
    found = [(x, r) for x, r in stars if x != r]
    yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(2)], names=["node", "root"])


def component_stars(edges: DataFrame, one_task: int = 0) -> DataFrame:
    """edges(u, v) -> (node, root): every node but the smallest of its component, with that smallest node.

    Self-loops, repeated rows and either direction are allowed; null ends are dropped. No edges: no rows. Up to
    `one_task` different edges, 16 bytes each, are joined in one task, which spares a small graph the rounds.
    """
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _signature(edges)
    if 0 < before[0] <= one_task:
        return cut(edges.coalesce(1).mapInArrow(_joined, "node long, root long"))
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = cut(small)
        after = _signature(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
