"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in hash order of doc_id, form blocks of `block_docs`. With weight w of a total W, block
k of the source may take no slot before floor(k W / w) and must take one before ceil((k + 1) W / w). Each
slot goes to the released block of earliest deadline (ties: source name). With whole weights that add up to
W this meets every deadline, so after any number of slots each source is less than one block away from its
share, and the schedule repeats every W slots: one period is scheduled on the driver and every block's slot
follows from it by arithmetic on the rows.

When a source has no block left, the rest go on among themselves with their own weights: a new phase, with
its own period. There are at most as many phases as sources, so the plan is bounded by sources and grain and
does not grow with the documents. All rows are kept.

Ranks within a source are not taken in one task: documents fall in hash buckets, the counts of the buckets
give offsets, and only rows of one source and bucket are ordered together.

A null source is a source of its own. Sources without a given weight get weight 1 of the grain. Repeated
rows take places of their own. No rows give no rows. More than `most_sources` sources are an error, since the
driver holds a row for each and schedules as many phases.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PLAN = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("starts", T.ArrayType(T.LongType())),
        T.StructField("base", T.ArrayType(T.LongType())),
        T.StructField("period", T.ArrayType(T.LongType())),
        T.StructField("slots", T.ArrayType(T.ArrayType(T.LongType()))),
    ]
)


def period(weights: list[int]) -> list[list[int]]:
    """The slots of each source in one period of sum(weights) slots, by earliest deadline first."""
    total = sum(weights)
    done = [0] * len(weights)
    found: list[list[int]] = [[] for _ in weights]
    pending = [(0, i) for i in range(len(weights))]
    heapq.heapify(pending)
    ready: list[tuple[int, int]] = []
    for slot in range(total):
        while pending and pending[0][0] <= slot:
            _, i = heapq.heappop(pending)
            heapq.heappush(ready, (-(-(done[i] + 1) * total // weights[i]), i))
        deadline, i = heapq.heappop(ready)
        if slot >= deadline:
            raise AssertionError("a block missed its deadline")
        found[i].append(slot)
        done[i] += 1
        if done[i] < weights[i]:
            heapq.heappush(pending, (done[i] * total // weights[i], i))
    return found


def schedule(blocks: dict[str | None, int], weights: dict[str | None, int]) -> list[tuple]:
    """blocks of each source -> rows of the plan: a source's first block, first slot, period and slots in each phase."""
    left = {s: n for s, n in blocks.items() if n > 0}
    used = dict.fromkeys(left, 0)
    plan: dict[str | None, list] = {s: [] for s in left}
    at = 0
    while left:
        live = sorted(left, key=lambda s: (s is not None, s or ""))
        parts = [weights.get(s, 1) for s in live]
        common = math.gcd(*parts)
        parts = [p // common for p in parts]
        total, slots = sum(parts), period(parts)
        span = min((left[s] - 1) // w * total + slots[i][(left[s] - 1) % w] for i, (s, w) in enumerate(zip(live, parts, strict=True))) + 1
        for i, (s, w) in enumerate(zip(live, parts, strict=True)):
            plan[s].append((used[s], at, total, slots[i]))
            taken = span // total * w + bisect_left(slots[i], span % total)
            used[s] += taken
            left[s] -= taken
        left = {s: n for s, n in left.items() if n > 0}
        at += span
    return [(s, [p[0] for p in rows], [p[1] for p in rows], [p[2] for p in rows], [p[3] for p in rows]) for s, rows in plan.items()]


def tempered(blocks: dict[str | None, int], power: float, grain: int) -> dict[str | None, int]:
    """Whole weights in proportion to blocks ** power, at least 1 each, about `grain` in all."""
    total = sum(n**power for n in blocks.values()) or 1.0
    return {s: max(1, round(grain * n**power / total)) for s, n in blocks.items()}


def _source_blocks(sized: DataFrame, block_docs: int, most_sources: int) -> dict[str | None, int]:
    rows = sized.groupBy("source").agg(F.sum("n").alias("n")).limit(most_sources + 1).collect()
    if len(rows) > most_sources:
        raise ValueError(f"more than {most_sources} sources; the plan holds a row and a phase for each, so give it groups of them")
    return {r["source"]: -(-r["n"] // block_docs) for r in rows}


def mix(docs: DataFrame, weights: dict[str | None, int] | None = None, block_docs: int = 16, power: float = 0.5, grain: int = 1000, bucket_rows: int = 4096, most_sources: int = 2000) -> DataFrame:
    """docs(doc_id, source, ...) -> docs and (mix_block, mix_phase, mix_slot, mix_position), positions unique and in training order.

    weights: whole parts by source; where None, in proportion to the blocks to the given power. The columns of docs
    travel as one, so names of theirs clash with none in here; those called as the four results are replaced.
    """
    kept = [c for c in docs.columns if c not in ("mix_block", "mix_phase", "mix_slot", "mix_position")]
    count = docs.count()
    bits = max(0, math.ceil(math.log2(max(1, count / bucket_rows))))
    plain = docs.select(F.struct(*[docs[c] for c in kept]).alias("row"), docs["source"].cast("string").alias("source"), docs["doc_id"].alias("id"), F.xxhash64(docs["doc_id"]).alias("h"))
    placed = plain.withColumn("bucket", F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long"))
    sized = placed.groupBy("source", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sized.select(F.col("source").alias("of"), F.col("bucket").alias("at"), F.coalesce(before, F.lit(0)).alias("offset"))
    blocks = _source_blocks(sized, block_docs, most_sources)
    plan = docs.sparkSession.createDataFrame(schedule(blocks, weights or tempered(blocks, power, grain)), _PLAN)
    within = Window.partitionBy("source", "bucket").orderBy("h", "id")
    ranked = placed.withColumn("rank", F.row_number().over(within) - 1)
    known = ranked.join(offsets, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("at"))).select("row", "source", (F.col("rank") + F.col("offset")).alias("place"))
    more = known.join(plan, F.col("source").eqNullSafe(F.col("name"))).withColumn("block", F.expr(f"place div {block_docs}")).withColumn("phase", F.expr(f"size(filter(starts, f -> f <= place div {block_docs})) - 1"))
    turn = "(block - starts[phase])"
    slot = F.expr(f"base[phase] + {turn} div size(slots[phase]) * period[phase] + slots[phase][cast({turn} % size(slots[phase]) as int)]")
    found = more.withColumn("slot", slot)
    return found.select("row.*", F.col("block").alias("mix_block"), F.col("phase").alias("mix_phase"), F.col("slot").alias("mix_slot"), (F.col("slot") * block_docs + F.col("place") % block_docs).alias("mix_position"))


def in_order(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs sorted into training order.

    Places are worked out on ids and sources alone, so whole rows move twice: to meet their place and to be
    sorted by it. Rows of the same doc_id and source share the first of their places and stand there in the order
    of a hash of all their columns.
    """
    places = mix(docs.select("doc_id", "source"), **options).groupBy(F.col("doc_id").alias("id"), F.col("source").alias("of")).agg(F.min("mix_position").alias("place"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.xxhash64(*[docs[c] for c in docs.columns]).alias("h"))
    met = rows.join(places, F.col("row.doc_id").eqNullSafe(F.col("id")) & F.col("row.source").eqNullSafe(F.col("of")))
    return met.select("row", "place", "h").orderBy("place", "h").select("row.*")
