"""A causal self-attention model of item sequences, trained by synchronous gradients on all partitions.

One pre-normalised layer: x = item vectors + positions; x += attention(norm(x)) over the items so far;
x += gelu layer(norm(x)); norm(x). The last state's dot products with item vectors are scores; the loss of an
example is the mean of -log sigmoid(positive - negative) over its negatives.

Item vectors are rows of a table, of any size: examples lie in blocks, a step joins the vectors to the different items of
each block, gets a gradient row an item back and joins these in again. The dense weights, some 12 size^2 numbers, go with the tasks; their gradients are added up
in each task, then in groups of tasks, and the driver adds a few groups. A step is one pass over all its examples, so
the partitioning changes only the order of sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideloom.functions.cuts import cut
from tideloom.operators.rank import dot_top_k

Weights = dict[str, np.ndarray]
_GROUPS = 16  # gradient sums that reach the driver
_GELU = (2 / np.pi) ** 0.5


def drawn_weights(size: int, length: int, seed: int = 0) -> Weights:
    """Normal weights of deviation size^-0.5, positions of 0.02, unit norms, no biases."""
    rng = np.random.default_rng(seed)
    square = lambda a, b: rng.normal(0, a**-0.5, (a, b))
    found = {"position": rng.normal(0, 0.02, (length, size)), "up": square(size, 4 * size), "up_bias": np.zeros(4 * size), "down": square(4 * size, size), "down_bias": np.zeros(size)}
    for name in ("query", "key", "value", "out"):
        found |= {name: square(size, size), f"{name}_bias": np.zeros(size)}
    for name in ("norm1", "norm2", "norm3"):
        found |= {name: np.ones(size), f"{name}_bias": np.zeros(size)}
    return found


def flat(weights: Weights) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in sorted(weights)])


def unflat(values: np.ndarray, like: Weights) -> Weights:
    found, at = {}, 0
    for k in sorted(like):
        found[k] = values[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return found


def _norm(x: np.ndarray, scale: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, tuple]:
    middle = x - x.mean(-1, keepdims=True)
    spread = 1 / np.sqrt((middle**2).mean(-1, keepdims=True) + 1e-5)
    return middle * spread * scale + bias, (middle * spread, spread)


def _norm_back(g: np.ndarray, scale: np.ndarray, kept: tuple, grads: Weights, name: str) -> np.ndarray:
    unit, spread = kept
    grads[name] += (g * unit).sum((0, 1))
    grads[f"{name}_bias"] += g.sum((0, 1))
    g = g * scale
    return spread * (g - g.mean(-1, keepdims=True) - unit * (g * unit).mean(-1, keepdims=True))


def _times(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w as one product and not one an example."""
    return (x.reshape(-1, x.shape[-1]) @ w).reshape(*x.shape[:-1], w.shape[1])


def forward(x: np.ndarray, there: np.ndarray, w: Weights) -> tuple[np.ndarray, dict]:
    """x[b, l, d]: item vectors, there[b, l]: no padding -> the states of all places, and what backward() needs."""
    length, size = x.shape[1:]
    x = x + w["position"][:length]
    a, n1 = _norm(x, w["norm1"], w["norm1_bias"])
    q, k, v = (_times(a, w[n]) + w[f"{n}_bias"] for n in ("query", "key", "value"))
    seen = np.tril(np.ones((length, length), bool)) & there[:, None, :]
    logits = np.where(seen, q @ k.transpose(0, 2, 1) / size**0.5, -1e30)
    share = np.exp(logits - logits.max(-1, keepdims=True)) * seen
    share /= np.maximum(share.sum(-1, keepdims=True), 1e-30)
    mixed = share @ v
    x1 = x + _times(mixed, w["out"]) + w["out_bias"]
    b, n2 = _norm(x1, w["norm2"], w["norm2_bias"])
    u = _times(b, w["up"]) + w["up_bias"]
    t = np.tanh(_GELU * (u + 0.044715 * u * u * u))
    h = 0.5 * u * (1 + t)
    x2 = x1 + _times(h, w["down"]) + w["down_bias"]
    out, n3 = _norm(x2, w["norm3"], w["norm3_bias"])
    return out, {"a": a, "n1": n1, "q": q, "k": k, "v": v, "share": share, "mixed": mixed, "b": b, "n2": n2, "u": u, "t": t, "h": h, "n3": n3}


def backward(g: np.ndarray, kept: dict, w: Weights) -> tuple[np.ndarray, Weights]:
    """g: gradient of the states -> (gradient of the item vectors, gradients of the weights)."""
    grads = {k: np.zeros_like(v) for k, v in w.items()}
    size = g.shape[-1]

    def linear(g: np.ndarray, x: np.ndarray, name: str) -> np.ndarray:
        grads[name] += x.reshape(-1, x.shape[-1]).T @ g.reshape(-1, g.shape[-1])
        grads[f"{name}_bias"] += g.sum((0, 1))
        return _times(g, w[name].T)

    g2 = _norm_back(g, w["norm3"], kept["n3"], grads, "norm3")
    u, t = kept["u"], kept["t"]
    slope = 0.5 * (1 + t) + 0.5 * u * (1 - t**2) * _GELU * (1 + 3 * 0.044715 * u**2)
    gu = linear(g2, kept["h"], "down") * slope
    g1 = g2 + _norm_back(linear(gu, kept["b"], "up"), w["norm2"], kept["n2"], grads, "norm2")
    gm = linear(g1, kept["mixed"], "out")
    share = kept["share"]
    gv, gs = share.transpose(0, 2, 1) @ gm, gm @ kept["v"].transpose(0, 2, 1)
    gl = share * (gs - (gs * share).sum(-1, keepdims=True)) / size**0.5
    ga = linear(gl @ kept["k"], kept["a"], "query") + linear(gl.transpose(0, 2, 1) @ kept["q"], kept["a"], "key") + linear(gv, kept["a"], "value")
    gx = g1 + _norm_back(ga, w["norm1"], kept["n1"], grads, "norm1")
    grads["position"][: g.shape[1]] += gx.sum(0)
    return gx, grads


def loss_and_gradients(x: np.ndarray, there: np.ndarray, positive: np.ndarray, negative: np.ndarray, w: Weights) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, Weights]:
    """Summed loss of left-padded examples, and its gradients by inputs, positive [b, d], negative [b, n, d] and weights."""
    states, kept = forward(x, there, w)
    s = states[:, -1]
    gap = (s * positive).sum(-1)[:, None] - np.einsum("bd,bnd->bn", s, negative)
    n = gap.shape[1]
    pull = -1 / (1 + np.exp(gap)) / n
    g = np.zeros_like(states)
    g[:, -1] = pull.sum(1)[:, None] * positive - np.einsum("bn,bnd->bd", pull, negative)
    gx, grads = backward(g, kept, w)
    return float(np.logaddexp(0, -gap).sum() / n), gx * there[..., None], pull.sum(1)[:, None] * s, -pull[..., None] * s[:, None], grads


def item_table(places: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """places(place) -> (place, vec): first vectors, normal with deviation 0.02 from the place alone."""

    @F.arrow_udf("array<double>")
    def first(column: pa.Array) -> pa.Array:
        return pa.array([np.random.default_rng([seed, p]).normal(0, 0.02, size) for p in column.to_pylist()], pa.list_(pa.float64()))

    return places.select(F.col("place").cast("long").alias("place")).distinct().select("place", first("place").alias("vec"))


def _cut_once(frame: DataFrame) -> DataFrame:
    """cut(), which makes its rows twice, of rows that are held meanwhile."""
    held = frame.persist()
    out = cut(held)
    held.unpersist()
    return out


_PACKED = "block long, unique array<long>, local binary, widths binary, events binary"


def packed(rows: DataFrame, block: int = 4096) -> DataFrame:
    """rows(event_id, places) -> a row a block of examples: its different places, and each example's as numbers into these, 0 for padding. Blocks lie within partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            values = np.maximum(batch.column(1).flatten().fill_null(0).to_numpy(zero_copy_only=False), 0)
            widths, events = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False), batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.r_[0, np.cumsum(widths)]
            for some in np.array_split(np.arange(n), -(-n // block)):
                low, high = some[0], some[-1] + 1
                unique, local = np.unique(np.r_[0, values[ends[low] : ends[high]]], return_inverse=True)
                row = (number, unique[1:], local[1:].astype(np.int32).tobytes(), widths[low:high].astype(np.int32).tobytes(), events[low:high].astype(np.int64).tobytes())
                number += 1
                kinds = (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, kinds, strict=True)], names=[c.split()[0] for c in _PACKED.split(", ")])

    return rows.where("places is not null").mapInArrow(run, _PACKED)


def _by_block(blocks: DataFrame, items: DataFrame, size: int, function, schema: str) -> DataFrame:
    """function(block, vectors) of each block of packed(). A vector is sent once a block, however many examples of it have the item; unknown items have zeros."""
    needs = blocks.select(F.col("block").alias("of"), F.posexplode("unique").alias("at", "place"))
    vectors = needs.join(items.select("place", "vec"), "place", "left").select("of", "at", F.coalesce("vec", F.array_repeat(F.lit(0.0), size)).alias("vec"))

    def run(block: pa.Table, met: pa.Table) -> pa.Table:
        unique = np.array(block.column("unique")[0].as_py(), np.int64)
        table = np.zeros((len(unique) + 1, size))
        table[met.column("at").to_numpy() + 1] = pc.list_flatten(met.column("vec")).to_numpy().reshape(-1, size)
        local, widths, events = (np.frombuffer(block.column(c)[0].as_py(), kind) for c, kind in (("local", np.int32), ("widths", np.int32), ("events", np.int64)))
        return function(unique, table, local, widths, events)

    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes are much work here
    return blocks.repartition(tasks, "block").groupBy("block").cogroup(vectors.groupBy("of")).applyInArrow(run, schema)


def _of_one_width(local: np.ndarray, widths: np.ndarray, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of examples, their places as a matrix), `rows` at most at a time."""
    starts = np.cumsum(widths) - widths
    for width in np.unique(widths):
        some = np.flatnonzero(widths == width)
        for at in range(0, len(some), rows):
            pick = some[at : at + rows]
            yield pick, local[starts[pick, None] + np.arange(width)]


_GRADIENT = "kind string, key long, vec array<double>, loss double, rows long"


def training_blocks(examples: DataFrame, length: int) -> DataFrame:
    """Blocks of examples(event_id, input, positive, negatives). Examples without negatives are left out."""
    return packed(examples.where(F.size("negatives") > 0).select("event_id", F.concat(F.slice("input", -length, length), F.array("positive"), "negatives").alias("places")))


def gradients(blocks: DataFrame, items: DataFrame, w: Weights, rows_a_step: int = 512) -> DataFrame:
    """training_blocks() -> (kind, key, vec, loss, rows): 'item' rows with an item's gradient, 'dense' with those of the weights. Both are added up in each block first."""
    length, size = w["position"].shape

    def run(unique: np.ndarray, table: np.ndarray, local: np.ndarray, widths: np.ndarray, events: np.ndarray) -> pa.Table:
        dense, loss, rows = np.zeros(flat(w).size), 0.0, 0
        by_item = np.zeros_like(table)
        for _, ids in _of_one_width(local, widths, rows_a_step):
            m = table[ids]
            one, gx, gp, gn, grads = loss_and_gradients(m[:, :length], ids[:, :length] > 0, m[:, length], m[:, length + 1 :], w)
            loss, rows = loss + one, rows + len(ids)
            dense += flat(grads)
            g, places = np.concatenate([gx, gp[:, None], gn], axis=1).reshape(-1, size), ids.ravel()
            by_item += np.stack([np.bincount(places, g[:, d], len(table)) for d in range(size)], axis=1)
        sums = _rows("item", dict(zip(unique.tolist(), by_item[1:], strict=True)), 0.0, 0)
        return pa.Table.from_batches([sums, _rows("dense", {0: dense}, loss, rows)])

    return _by_block(blocks, items, size, run, _GRADIENT)


def _rows(kind: str, vecs: dict[int, np.ndarray], loss: float, rows: int) -> pa.RecordBatch:
    n = len(vecs)
    return pa.RecordBatch.from_arrays([pa.array([kind] * n), pa.array(list(vecs), pa.int64()), pa.array(list(vecs.values()), pa.list_(pa.float64())), pa.array([loss] * n), pa.array([rows] * n, pa.int64())], names=["kind", "key", "vec", "loss", "rows"])


def _summed(group: pa.Table) -> pa.Table:
    total = np.sum([np.asarray(v) for v in group.column("vec").to_pylist()], axis=0)
    return pa.table([pa.array([group.column("key")[0].as_py()], pa.int64()), pa.array([total], pa.list_(pa.float64())), pa.array([sum(group.column("loss").to_pylist())]), pa.array([sum(group.column("rows").to_pylist())], pa.int64())], names=["key", "vec", "loss", "rows"])


def fit(examples: DataFrame, items: DataFrame, weights: Weights, steps: int = 10, rate: float = 0.5) -> tuple[DataFrame, Weights, list[float]]:
    """(items, weights, losses): `steps` gradient steps of mean loss over all examples. items(place, vec) is cut after each."""
    blocks = _cut_once(training_blocks(examples, weights["position"].shape[0]))
    items, losses = cut(items.select("place", "vec")), []
    schema = "key long, vec array<double>, loss double, rows long"
    for _ in range(steps):
        made = _cut_once(gradients(blocks, items, weights))
        dense = made.where("kind = 'dense'").withColumn("key", F.pmod(F.xxhash64("vec"), F.lit(_GROUPS))).groupBy("key").applyInArrow(_summed, schema).collect()
        rows = sum(r["rows"] for r in dense)
        if not rows:
            return items, weights, losses
        losses.append(sum(r["loss"] for r in dense) / rows)
        weights = unflat(flat(weights) - rate * np.sum([np.asarray(r["vec"]) for r in sorted(dense, key=lambda r: r["key"])], axis=0) / rows, weights)
        by_item = made.where("kind = 'item'").groupBy("key").applyInArrow(_summed, schema).select(F.col("key").alias("place"), F.col("vec").alias("g"))
        moved = F.when(F.col("g").isNull(), F.col("vec")).otherwise(F.zip_with("vec", "g", lambda v, g: v - F.lit(rate / rows) * g))
        items = cut(items.join(by_item, "place", "left").select("place", moved.alias("vec")))
    return items, weights, losses


def states(cases: DataFrame, items: DataFrame, w: Weights) -> DataFrame:
    """cases(event_id, input as left-padded places) -> (event_id, vector): the last state of each case; zeros without any item."""
    length, size = w["position"].shape

    def run(unique: np.ndarray, table: np.ndarray, local: np.ndarray, widths: np.ndarray, events: np.ndarray) -> pa.Table:
        out = np.zeros((len(events), size))
        for some, ids in _of_one_width(local, widths, 512):
            out[some] = forward(table[ids], ids > 0, w)[0][:, -1] * (ids[:, -1:] > 0)
        return pa.table([pa.array(events), pa.array(list(out), pa.list_(pa.float64()))], names=["event_id", "vector"])

    rows = cases.where("event_id is not null").select(F.col("event_id").cast("long").alias("event_id"), F.slice("input", -length, length).alias("places")).where(F.size("places") > 0)
    return _by_block(cut(packed(rows)), items, size, run, "event_id long, vector array<double>")


def top_k(cases: DataFrame, items: DataFrame, w: Weights, k: int) -> DataFrame:
    """The k best items of each case among all, blocks of cases against blocks of items: (event_id, place, score, rank)."""
    asked = _cut_once(states(cases, items, w).select((-1 - F.col("event_id")).alias("query_id"), "vector"))  # no case has an item's number
    found = dot_top_k(asked, items.select(F.col("place").alias("item_id"), F.col("vec").alias("vector")), k)
    return found.select((-1 - F.col("query_id")).alias("event_id"), F.col("item_id").alias("place"), "score", "rank")


def score_pool(candidates: DataFrame, cases: DataFrame, items: DataFrame, w: Weights) -> DataFrame:
    """candidates(event_id, place) of each case with score and rank; the case's state is made once."""
    met = candidates.join(states(cases, items, w), "event_id").join(items.select("place", "vec"), "place")
    score = F.aggregate(F.zip_with("vector", "vec", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    order = Window.partitionBy("event_id").orderBy(F.desc("score"), "place")
    return met.select("event_id", "place", score.alias("score")).withColumn("rank", F.row_number().over(order))
