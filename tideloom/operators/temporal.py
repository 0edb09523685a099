"""Node memories of a user-item event graph, replayed in time order, and scores that read them as of a case.

An event changes its user's and its item's memory by a gated recurrent update of (user memory, item memory,
log1p of time); both were changed by earlier events, so the replay is bound to an order. Time is cut into slices.
Within one, an event reads the *other* node's memory as it stood at the slice's start, and each node folds its own
events in order. Rounds are slices, not the longest chain of events. Where no node has two events in a slice that
is the exact replay.

Memories are a table from round to round and its lineage is cut; a node without events has no row, its first
memory follows from its id. A task folds the nodes of its partition as they stream by and holds one Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideloom.functions.cuts import cut
from tideloom.functions.deal import together

USER, ITEM = 0, 1


@dataclass(frozen=True)
class Gate:
    """The weights of one gated recurrent update; rows are the reset, update and new gates of `size` values each."""

    inputs: np.ndarray
    hidden: np.ndarray
    input_bias: np.ndarray
    hidden_bias: np.ndarray

    def __call__(self, x: np.ndarray, h: np.ndarray) -> np.ndarray:
        size = h.shape[1]
        a, b = x @ self.inputs.T + self.input_bias, h @ self.hidden.T + self.hidden_bias
        reset, update = (1 / (1 + np.exp(-(a[:, i : i + size] + b[:, i : i + size]))) for i in (0, size))
        new = np.tanh(a[:, 2 * size :] + reset * b[:, 2 * size :])
        return (1 - update) * new + update * h


@dataclass(frozen=True)
class Encoder:
    """Both gates, the projection of time and the seed of first memories."""

    size: int
    gates: tuple[Gate, Gate]
    time_weight: np.ndarray
    time_bias: np.ndarray
    seed: int

    @classmethod
    def drawn(cls, size: int = 16, seed: int = 0) -> Encoder:
        """Uniform weights within 1 / sqrt(size), time within 1."""
        rng, most = np.random.default_rng(seed), size**-0.5
        gates = [Gate(rng.uniform(-most, most, (3 * size, 2 * size + 1)), rng.uniform(-most, most, (3 * size, size)), rng.uniform(-most, most, 3 * size), rng.uniform(-most, most, 3 * size)) for _ in (USER, ITEM)]
        return cls(size, (gates[0], gates[1]), rng.uniform(-1, 1, size), rng.uniform(-1, 1, size), seed)

    def first(self, kind: int, node: int) -> np.ndarray:
        """A node's memory before its first event: normal with deviation 0.02, from its id alone."""
        return np.random.default_rng([self.seed, kind, node & (2**64 - 1)]).normal(0, 0.02, self.size)


def clock(ts: np.ndarray) -> np.ndarray:
    return np.log1p(np.maximum(ts, 0))


def time_bounds(events: DataFrame, slices: int) -> list[int]:
    """Times that cut the events into about equal slices; one time is never cut."""
    if slices <= 1:
        return []
    found = events.where("ts is not null").approxQuantile("ts", [i / slices for i in range(1, slices)], 0.1 / slices)
    return sorted({int(x) + 1 for x in found})


def _vectors(column: pa.Array, size: int) -> list[np.ndarray | None]:
    return [None if v is None else np.asarray(v) for v in column.to_pylist()]


def _fold(sliced: DataFrame, encoder: Encoder, kind: int) -> DataFrame:
    """sliced(node, other, ts, own, met) -> (kind, id, ts, seq, vec): each node's memory after each of its events."""
    gate, size = encoder.gates[kind], encoder.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, np.ndarray, int] | None = None  # the last node of the batch before, its memory and its events so far
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            node = batch.column(0).to_numpy(zero_copy_only=False)
            other = batch.column(1).to_pylist()
            ts = batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
            met = np.array([encoder.first(1 - kind, o) if v is None else v for o, v in zip(other, _vectors(batch.column(4), size), strict=True)])
            starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            counts = np.diff(np.r_[starts, n])
            own = batch.column(3).take(pa.array(starts))
            state = np.array([encoder.first(kind, int(node[s])) if v is None else v for s, v in zip(starts, _vectors(own, size), strict=True)])
            before = np.zeros(len(starts), dtype=np.int64)
            if held and held[0] == node[0]:
                state[0], before[0] = held[1], held[2]
            after, seq = np.zeros((n, size)), np.zeros(n, dtype=np.int64)
            for step in range(int(counts.max())):
                some = np.flatnonzero(counts > step)
                rows = starts[some] + step
                h, m = state[some], met[rows]
                x = np.concatenate([h, m] if kind == USER else [m, h], axis=1)
                state[some] = gate(np.c_[x, clock(ts[rows])], h)
                after[rows], seq[rows] = state[some], before[some] + step
            held = (int(node[-1]), state[-1].copy(), int(before[-1] + counts[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, dtype=np.int32)), pa.array(node), batch.column(2), pa.array(seq), pa.array(list(after), pa.list_(pa.float64()))], names=["kind", "id", "ts", "seq", "vec"])

    ordered = together(sliced, "node").sortWithinPartitions("node", "ts", "other").select("node", "other", "ts", "own", "met")
    return ordered.mapInArrow(run, "kind int, id long, ts long, seq long, vec array<double>")


def replay(events: DataFrame, encoder: Encoder, bounds: Sequence[int], memory: DataFrame | None = None) -> DataFrame:
    """events(user_id, item_id, ts) -> (kind, id, ts, slice, seq, vec): every version of every node's memory.

    Slice i ends before bounds[i]. memory(kind, id, vec) goes on from an earlier replay. Events of one time are in
    the order of the other node's id, as a null time is the earliest; events without a user or item are left out.
    """
    known = events.where("user_id is not null and item_id is not null").select(F.col("user_id").cast("long"), F.col("item_id").cast("long"), F.coalesce(F.col("ts").cast("long"), F.lit(-1)).alias("ts"))
    known = cut(known)
    state = memory.select("kind", "id", "vec") if memory is not None else known.sparkSession.createDataFrame([], "kind int, id long, vec array<double>")
    parts = []
    for number, (low, high) in enumerate(zip([None, *bounds], [*bounds, None], strict=True)):
        some = known
        if low is not None:
            some = some.where(F.col("ts") >= low)
        if high is not None:
            some = some.where(F.col("ts") < high)
        users = state.where(F.col("kind") == USER).select(F.col("id").alias("user_id"), F.col("vec").alias("user_vec"))
        items = state.where(F.col("kind") == ITEM).select(F.col("id").alias("item_id"), F.col("vec").alias("item_vec"))
        met = some.join(users, "user_id", "left").join(items, "item_id", "left")
        by_user = met.select(F.col("user_id").alias("node"), F.col("item_id").alias("other"), "ts", F.col("user_vec").alias("own"), F.col("item_vec").alias("met"))
        by_item = met.select(F.col("item_id").alias("node"), F.col("user_id").alias("other"), "ts", F.col("item_vec").alias("own"), F.col("user_vec").alias("met"))
        made = cut(_fold(by_user, encoder, USER).union(_fold(by_item, encoder, ITEM)).withColumn("slice", F.lit(number)))
        parts.append(made)
        last = made.groupBy("kind", "id").agg(F.max_by("vec", "seq").alias("vec"))
        state = cut(state.join(last, ["kind", "id"], "left_anti").union(last))
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    return found.select("kind", "id", "ts", "slice", "seq", "vec")


def memory_before(asked: DataFrame, versions: DataFrame, kind: int, node: str, name: str) -> DataFrame:
    """asked(node, ts, ...) with the node's last version strictly before ts as `name`, null where there is none. One sorted pass."""
    rows = asked.select(F.col(node).alias("__node"), F.col("ts").alias("__ts"), F.lit(0).alias("__late"), F.lit(None).cast("int").alias("__slice"), F.lit(None).cast("long").alias("__seq"), F.lit(None).cast("array<double>").alias("__vec"), F.struct("*").alias("__row"))
    kept = versions.where(F.col("kind") == kind).select("id", "ts", F.lit(1), "slice", "seq", "vec", F.lit(None).cast(rows.schema["__row"].dataType))
    w = Window.partitionBy("__node").orderBy("__ts", "__late", "__slice", "__seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.union(kept).withColumn(name, F.last("__vec", ignorenulls=True).over(w)).where("__row is not null")
    return found.select("__row.*", name)


def _first_memories(encoder: Encoder, kind: int):
    @F.arrow_udf("array<double>")
    def first(nodes: pa.Array) -> pa.Array:
        return pa.array([None if n is None else encoder.first(kind, n) for n in nodes.to_pylist()], pa.list_(pa.float64()))

    return first


def scores(asked: DataFrame, versions: DataFrame, time_weight: Sequence[float], time_bias: Sequence[float], encoder: Encoder | None = None) -> DataFrame:
    """asked(event_id, user_id, item_id, ts) -> with `score`: (user memory + time projection) . item memory, both as of ts.

    A node without a version has its first memory where an encoder is given, and zeros otherwise. A later event
    changes no score.
    """
    met = memory_before(memory_before(asked, versions, USER, "user_id", "__user"), versions, ITEM, "item_id", "__item")
    if encoder is not None:
        for kind, node, vec in ((USER, "user_id", "__user"), (ITEM, "item_id", "__item")):
            untouched = F.when(F.col(vec).isNull(), F.col(node).cast("long"))
            met = met.withColumn(vec, F.coalesce(vec, _first_memories(encoder, kind)(untouched)))
    at = F.log1p(F.greatest(F.coalesce("ts", F.lit(0)), F.lit(0)).cast("double"))
    parts = [(F.coalesce(F.col("__user")[i], F.lit(0.0)) + at * float(w) + float(b)) * F.coalesce(F.col("__item")[i], F.lit(0.0)) for i, (w, b) in enumerate(zip(time_weight, time_bias, strict=True))]
    return met.withColumn("score", sum(parts[1:], parts[0])).drop("__user", "__item")


def ranked(asked: DataFrame, versions: DataFrame, encoder: Encoder) -> DataFrame:
    """Candidates of each case by their score, ties by id: asked with score and rank."""
    found = scores(asked, versions, encoder.time_weight.tolist(), encoder.time_bias.tolist(), encoder)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("event_id").orderBy(F.desc("score"), "item_id")))
