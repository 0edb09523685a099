"""Helpers the text operators share."""

from __future__ import annotations

import ctypes
import math
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideloom.functions.cuts import cut

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_CHUNK_BYTES = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(frame: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that extra columns of any name cannot clash."""
    return frame.select(*[frame[n] for n in names])


def word_chunks(data: bytes, size: int = 200_000) -> Iterator[list[bytes]]:
    """Words of a UTF-8 text in lists of bounded length. bytes.split() separates at 0x20 and 0x09-0x0D."""
    if len(data) <= _CHUNK_BYTES:
        if words := data.split():
            yield words
        return
    found = (m.group() for m in _WORD.finditer(data))
    while words := list(islice(found, size)):
        yield words


def binary(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    return column.cast(pa.large_binary()).to_pylist()


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker returns the memory that it no longer uses to the system: an idle worker counts with its executor."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
        if trim:
            trim(0)

    return whole


def map_batches(frame: DataFrame, make: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch] | pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow for a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = make(batch)
            if isinstance(made, pa.RecordBatch):
                yield made
            else:
                yield from made

    return frame.mapInArrow(giving_back(run), schema)


def bitmap(hashes: DataFrame, most_bits: int = 26) -> np.ndarray:
    """hashes(h) -> one bit for each of their cells: eight cells a hash, 2 ** most_bits (8 MB) in all at most. Cell c is bit c % 64 of word c // 64."""
    bits = max(6, min(most_bits, math.ceil(math.log2(8 * max(1, hashes.count())))))
    words = hashes.select(F.pmod("h", F.lit(1 << bits)).alias("c")).groupBy(F.expr("c div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(c % 64 as int))")).alias("set"))
    found = np.zeros((1 << bits) // 64, dtype=np.int64)
    for r in words.collect():
        found[r["word"]] = r["set"]
    return found


def spread_join(many: DataFrame, one: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """many joined with one(key, ...) of distinct keys, where a key may hold a large part of many's rows.

    Keys with over one in `share` of the rows are fewer than `share`; their rows of `one` are broadcast.
    """
    total = many.count()
    crowds = cut(many.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") * share > total).select(key))
    if crowds.isEmpty():
        return many.join(one, key)
    crowds = F.broadcast(crowds)
    few = F.broadcast(cut(one.join(crowds, key, "left_semi")))
    return many.join(few, key).union(many.join(crowds, key, "left_anti").join(one, key))
