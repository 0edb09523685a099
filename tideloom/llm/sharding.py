"""Sharding by extendible hashing, with DataFrame functions only.

A document's key is the 64-bit XXH64 of its doc_id. A bucket is a hash prefix; a bucket over the byte limit
splits on one more bit, any other stays, so each document lies in the bucket of the shortest prefix of its
hash that fits. Splitting is level by level over aggregates, not over documents: one aggregation gives the
bytes of every cell at a directory depth a few bits beyond log2(total / limit), the cells' sums give the
bytes of all shorter prefixes, and only the documents of cells that are still too large are aggregated
again, `STEP` bits deeper. The directory has one row a cell, which is in proportion to total / limit, and is
joined to the documents on the cell, never broadcast by hint.

Rows whose 64 hash bits all agree (one doc_id repeated, or a single document over the limit) cannot be told
apart by any prefix. They are cut at depth 64 into overflow shards by their running byte count, over equal
slices of a second hash so that no task has to hold such a group; a single document over the limit is an
overflow shard of its own. Null texts count zero bytes, a null doc_id hashes like any value, no rows give
no shards.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideloom.functions.cuts import cut

STEP = 8


def _directory(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """cells(cell, bytes, docs) at depth `high` -> (cell, depth, shard_bytes, shard_docs) with the least depth from `low` whose prefix fits; null where none does."""
    depths = F.explode(F.sequence(F.lit(low), F.lit(high)))
    levels = cells.select("cell", "bytes", "docs", depths.alias("depth")).withColumn("prefix", F.expr(f"shiftrightunsigned(cell, {high} - depth)"))
    sums = levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs")).where(F.col("shard_bytes") <= limit)
    fits = levels.select("cell", "depth", "prefix").join(sums, ["depth", "prefix"]).groupBy("cell").agg(F.min_by(F.struct("depth", "shard_bytes", "shard_docs"), "depth").alias("fit"))
    return cells.select("cell").join(fits, "cell", "left").select("cell", "fit.depth", "fit.shard_bytes", "fit.shard_docs")


def shard(docs: DataFrame, byte_limit: int) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_bytes, hash, shard_id, depth, shard_bytes, shard_docs).

    shard_id is the bit prefix as text, empty at depth 0, with `+n` behind it for overflow shard n.
    """
    if byte_limit < 1:
        raise ValueError("byte_limit must be at least 1")
    sized = docs.select(docs["doc_id"], F.coalesce(F.octet_length(docs["text"]), F.lit(0)).cast("long").alias("n_bytes"), F.xxhash64(docs["doc_id"]).alias("h"), F.xxhash64(docs["text"]).alias("tie"))
    rest = cut(sized)
    total = rest.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    low, high = 0, min(64, max(0, math.ceil(math.log2(max(1, total / byte_limit)))) + 6)
    placed: list[DataFrame] = []
    while True:
        keyed = rest.withColumn("cell", F.shiftrightunsigned("h", 64 - high) if high else F.lit(0).cast("long"))
        cells = cut(keyed.groupBy("cell").agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("docs")))
        directory = cut(_directory(cells, low, high, byte_limit))
        placed.append(keyed.join(directory.where("depth is not null"), "cell").withColumn("part", F.lit(None).cast("long")))
        over = directory.where("depth is null").select("cell")
        if over.isEmpty():
            break
        rest = cut(keyed.join(over, "cell", "left_semi").select("doc_id", "n_bytes", "h", "tie"))
        if high == 64:
            placed.append(_overflow(rest, byte_limit))
            break
        low, high = high + 1, min(64, high + STEP)
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    bits = F.expr("substring(lpad(bin(h), 64, '0'), 1, depth)")
    name = F.when(F.col("part").isNull(), bits).otherwise(F.concat(bits, F.lit("+"), F.col("part")))
    return out.select("doc_id", "n_bytes", F.col("h").alias("hash"), name.alias("shard_id"), F.col("depth").cast("int").alias("depth"), "shard_bytes", "shard_docs")


def _overflow(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of equal hash, cut into parts of at most `limit` bytes (or one row).

    Rows are dealt over slices, and a slice's rows laid one after another, smallest first. A part takes the
    rows that begin within one stretch of limit - largest + 1 bytes, so it holds `limit` bytes at most; a
    row over the limit is a part of its own.
    """
    dealt = cut(rows.withColumn("slice", F.pmod(F.xxhash64("tie", F.spark_partition_id(), F.monotonically_increasing_id()), F.lit(256))))
    each = dealt.where(F.col("n_bytes") <= limit).groupBy("h").agg(F.max("n_bytes").alias("largest"))
    order = Window.partitionBy("h", "slice").orderBy("n_bytes", "tie").rowsBetween(Window.unboundedPreceding, -1)
    laid = dealt.join(each, "h", "left").withColumn("before", F.coalesce(F.sum("n_bytes").over(order), F.lit(0)))
    room = F.lit(limit) - F.coalesce(F.col("largest"), F.lit(0)) + 1
    cut_up = laid.withColumn("turn", F.when(F.col("n_bytes") > limit, -1 - F.col("before")).otherwise(F.floor(F.col("before") / room)))
    parts = cut_up.groupBy("h", "slice", "turn").agg(F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_docs"))
    numbered = parts.withColumn("part", F.row_number().over(Window.partitionBy("h").orderBy("slice", "turn")).cast("long") - 1)
    return cut_up.join(numbered, ["h", "slice", "turn"]).select("doc_id", "n_bytes", "h", F.lit(64).alias("depth"), "shard_bytes", "shard_docs", "part")
