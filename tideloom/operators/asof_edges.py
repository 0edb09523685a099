"""The edges of each case's sources as they stood before it, by a walk over time that sends moves and cases but no pair of both."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideloom.functions.deal import together
from tideloom.operators.graph import GAP_BUCKETS

_GAPS = [f"gap_{b}" for b in GAP_BUCKETS]
_EDGE, _TARGET, _ASK, _MOVE = range(4)
_LAYOUT = ("slice", "part", "ts", "kind", "x", "y", "n", "last_ts", *_GAPS)
_SCHEMA = "event_id long, source_id long, target_id long, support long, transition_probability double, lift double, last_ts long, " + ", ".join(f"{g} long" for g in _GAPS)
_FLUSH = 20_000


class _Known:
    """Edges of some sources, and the moves into all targets, up to a time."""

    def __init__(self) -> None:
        self.edges: dict[tuple[int, int], int] = {}
        self.sources: dict[int, list] = {}  # total, slots as a list, slots as an array or None
        self.targets: dict[int, int] = {}
        self.values, self.into, self.target_of = np.zeros((64, 2 + len(_GAPS)), np.int64), np.zeros(64, np.int64), np.zeros(64, np.int64)
        self.names = np.zeros(64, np.int64)
        self.total = 0

    def target(self, y: int) -> int:
        t = self.targets.setdefault(y, len(self.targets))
        if t == len(self.into):
            self.into, self.names = (np.concatenate([a, np.zeros_like(a)]) for a in (self.into, self.names))
        self.names[t] = y
        return t

    def edge(self, x: int, y: int | None, n: int) -> int | None:
        source = self.sources.setdefault(x, [0, [], None])
        source[0] += n
        if y is None:
            return None
        e = self.edges.get((x, y))
        if e is None:
            e = self.edges[x, y] = len(self.edges)
            if e == len(self.values):
                self.values, self.target_of = (np.concatenate([a, np.zeros_like(a)]) for a in (self.values, self.target_of))
            self.target_of[e] = self.target(y)
            source[1].append(e)
            source[2] = None
        return e

    def slots(self, source: list) -> np.ndarray:
        if source[2] is None:
            source[2] = np.array(source[1], np.int64)
        return source[2]


def _cut_best(score: str, most: int, asks: np.ndarray, found: dict[str, np.ndarray]) -> np.ndarray:
    """Rows among the `most` best of their ask by the order of asof.merged_candidates(). For pmi, whose logarithms Spark takes, a few more by lift."""
    loose = score == "pmi"
    s = found["lift" if loose else f"gap_{score}" if score in GAP_BUCKETS else score].astype(np.float64)
    kept = np.flatnonzero(s > (1 - 1e-9 if loose else 0))
    s, asks = s[kept], asks[kept]
    order = np.lexsort((found["target_id"][kept], -found["last_ts"][kept], -found["support"][kept], -s, asks))
    s, asks, kept = s[order], asks[order], kept[order]
    starts = np.flatnonzero(np.r_[True, asks[1:] != asks[:-1]]) if len(asks) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[starts, len(asks)])
    if not loose:
        return kept[np.arange(len(asks)) - np.repeat(starts, counts) < most]
    least = np.where(counts >= most, s[np.minimum(starts + most, starts + counts) - 1], -np.inf) if len(asks) else s
    return kept[s >= np.repeat(least, counts) * (1 - 1e-9)]


def _walk(best: tuple[str, int] | None):
    names = [c.split()[0] for c in _SCHEMA.split(", ")]

    def flush(held: list) -> pa.RecordBatch:
        events, sources, lengths, totals, alls = (np.array([h[i] for h in held]) for i in range(5))
        values, targets, into = (np.concatenate([h[i] for h in held]) for i in (5, 6, 7))
        share = values[:, 0] / np.repeat(totals, lengths)
        found = {"event_id": np.repeat(events, lengths), "source_id": np.repeat(sources, lengths), "target_id": targets, "support": values[:, 0], "transition_probability": share, "lift": share / (into / np.repeat(alls, lengths)), "last_ts": values[:, 1]}
        found |= {g: values[:, 2 + i] for i, g in enumerate(_GAPS)}
        if best:
            kept = _cut_best(*best, np.repeat(np.arange(len(held)), lengths), found)
            found = {k: v[kept] for k, v in found.items()}
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[c])) for c in names], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, known, held, rows = None, _Known(), [], 0
        for batch in batches:
            for piece, part, ts, kind, x, y, n, last, *gaps in zip(*[batch.column(c).to_pylist() for c in _LAYOUT], strict=True):
                if task != (piece, part):
                    task, known = (piece, part), _Known()
                if kind == _ASK:
                    source = known.sources.get(y)
                    if source is None or not source[1]:
                        continue
                    at = known.slots(source)
                    to = known.target_of[at]
                    held.append((x, y, len(at), source[0], known.total, known.values[at], known.names[to], known.into[to]))
                    rows += len(at)
                    if rows >= _FLUSH:
                        yield flush(held)
                        rows = 0
                elif kind == _MOVE:
                    known.total += 1
                    if x is not None:
                        e = known.edge(x, y, 1)
                        if e is not None:
                            values = known.values[e]
                            values[0] += 1
                            values[1] = ts
                            values[2 + n] += 1
                    if y is not None:
                        known.into[known.target(y)] += 1
                elif kind == _EDGE:
                    e = known.edge(x, y, n)
                    if e is not None:
                        known.values[e] = (n, last, *gaps)
                else:
                    known.total += n
                    if y is not None:
                        t = known.target(y)
                        known.into[t] += n
        if held:
            yield flush(held)

    return run


def _bounds(frame: DataFrame, pieces: int) -> list[int]:
    if pieces < 2:
        return []
    return [int(x) + 1 for x in frame.approxQuantile("ts", [i / pieces for i in range(1, pieces)], 0.1 / pieces)]


def _before(rows: DataFrame, keys: list[str], slices: int, sums: list[Column]) -> DataFrame:
    """Sums by keys over all slices before each slice, from the first on that has any: one row a key and slice."""
    w = Window.partitionBy(*keys).orderBy("slice")
    each = rows.groupBy("slice", *keys).agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"), *sums)
    so_far = [F.sum(c).over(w).alias(c) for c in each.columns if c not in ("slice", "last_ts", *keys)]
    placed = each.select(*keys, "slice", F.max("last_ts").over(w).alias("last_ts"), *so_far, F.lead("slice", 1, slices).over(w).alias("__to")).where(F.col("slice") < slices)
    return placed.withColumn("slice", F.explode(F.sequence(F.col("slice") + 1, F.col("__to")))).drop("__to")


def edges_before(timed: DataFrame, moves: DataFrame, best: tuple[str, int] | None = None, asks_a_slice: int = 10_000, edges_a_task: int = 500_000) -> DataFrame:
    """timed(event_id, source_id, ts), moves(source_id, target_id, ts, bucket as a place in GAP_BUCKETS) -> every edge of the source strictly before ts.

    (event_id, source_id, target_id, support, transition_probability, lift, last_ts, gap_*). Time is cut into slices of
    about equal asks and moves. A task is a slice and a part of the sources: it starts from the edges and target counts before
    its slice and walks the slice's moves and asks in order, so what meets a case is made where it is returned.
    A task holds its sources' edges, some edges_a_task, and the targets' counts. Slices are no more than the moves
    an edge has, so the starting rows are no more than the moves. With best, a score and a number, only each
    ask's best are returned (for pmi a few more). Both inputs are read several times and should be cut.
    """
    timed = timed.where("event_id is not null and source_id is not null and ts is not null")
    asked = timed.agg(F.count("*").alias("n"), F.min("ts").alias("low")).first()
    by_edge = moves.groupBy("source_id", "target_id").agg(F.count("*").alias("n"))
    size = by_edge.agg(F.count("*").alias("edges"), F.coalesce(F.sum("n"), F.lit(0)).alias("moves")).first()
    pieces = max(1, min(-(-asked["n"] // asks_a_slice), size["moves"] // max(1, 2 * size["edges"])))
    parts = max(1, -(-size["edges"] // edges_a_task))
    low = asked["low"] if asked["low"] is not None else 0
    inner = {b for b in (*_bounds(timed, pieces), *_bounds(moves.where(F.col("ts") >= low), pieces)) if b > low}
    splits = [-float("inf"), float(low), *map(float, sorted(inner)), float("inf")]
    slices = len(splits) - 2  # number 0 is before all asks
    place = Bucketizer(splits=splits, inputCol="__ts", outputCol="__slice")

    def sliced(frame: DataFrame) -> DataFrame:
        return place.transform(frame.withColumn("__ts", F.col("ts").cast("double"))).withColumn("slice", F.col("__slice").cast("int")).drop("__ts", "__slice")

    def shaped(frame: DataFrame, kind: int, part: Column, **columns: Column | str) -> DataFrame:
        given = {"kind": F.lit(kind), "part": part, **{k: F.col(v) if isinstance(v, str) else v for k, v in columns.items()}}
        kinds = {"slice": "int", "part": "int", "kind": "int"}
        return frame.select(*[given.get(c, F.col(c) if c == "slice" else F.lit(None)).cast(kinds.get(c, "long")).alias(c) for c in _LAYOUT])

    own = F.pmod(F.xxhash64("source_id"), F.lit(parts))
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    moved = sliced(moves)
    gaps = [F.count_if(F.col("bucket") == i).alias(g) for i, g in enumerate(_GAPS)]
    edges = _before(moved.where("source_id is not null"), ["source_id", "target_id"], slices, gaps)
    into = _before(moved, ["target_id"], slices, []).withColumn("__part", every)
    steps = moved.where("slice > 0").withColumn("__part", every)
    rows = shaped(edges, _EDGE, own, x="source_id", y="target_id", n="n", last_ts="last_ts", **{g: g for g in _GAPS})
    rows = rows.union(shaped(into, _TARGET, F.col("__part"), y="target_id", n="n"))
    rows = rows.union(shaped(sliced(timed), _ASK, own, ts="ts", x="event_id", y="source_id"))
    rows = rows.union(shaped(steps, _MOVE, F.col("__part"), ts="ts", x=F.when(own == F.col("__part"), F.col("source_id")), y="target_id", n="bucket"))
    return together(rows, "slice", "part").sortWithinPartitions("slice", "part", "ts", "kind", "x").mapInArrow(_walk(best), _SCHEMA)
