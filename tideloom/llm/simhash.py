"""Near-duplicates by SimHash with pigeonring candidate pruning.

A 64-bit fingerprint is cut into a ring of seven segments. Two fingerprints at two or fewer differing bits
have, by the pigeonring principle, a starting segment from which every chain of l consecutive segments
differs in at most floor(2 l / 7) bits. For l = 3 that budget is zero, so the three leading segments are an
exact join key of 27 or 28 bits; the budgets of the longer chains prune the joined pairs before the full
Hamming check, which is the chain of all seven.

Work is on distinct fingerprints, so copies cost nothing. A bucket of one key with more than `bucket_pairs`
members is not paired off: its members are linked through the 65 values within one bit of each. Two values
at distance two or less share such a neighbour and a neighbour has at most 65 members, so that way is exact
and linear in the bucket.

Null, empty and blank texts have fingerprint zero and link like any other. Repeated rows share a
fingerprint. A null doc_id never becomes a component id unless its group has no other.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideloom.functions.cuts import cut
from tideloom.llm.common import binary, map_batches, only, spread_join, word_chunks
from tideloom.llm.components import component_stars

SEGMENTS = 7
SEED = 42


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def ring_masks(segments: int = SEGMENTS) -> list[list[int]]:
    """masks[i][l - 1] covers the l consecutive segments that start with segment i."""
    edges = [64 * i // segments for i in range(segments + 1)]
    single = [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:], strict=False)]
    return [[sum(single[(i + k) % segments] for k in range(n)) for n in range(1, segments + 1)] for i in range(segments)]


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """Bit b is set if it is set in over half of the XXH64 values of the word shingles, repeats included."""
    ones, total, tail = np.zeros(64, dtype=np.int64), 0, []
    if text is None:
        return 0
    short: list[bytes] = []
    for words in word_chunks(text.lower()):
        words = tail + words
        if len(words) < width:
            short = words
            tail = words
            continue
        grams = map(b" ".join, zip(*[words[i:] for i in range(width)], strict=False))
        n = len(words) - width + 1
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), dtype="<u8", count=n)
        for at in range(0, n, 65_536):
            part = hashes[at : at + 65_536]
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += n
        tail = words[len(words) - width + 1 :] if width > 1 else []
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(short), SEED) if short else 0
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fp) with fp the fingerprint's bits as a signed long."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.array([fingerprint(t, width) for t in binary(batch.column(1))], dtype=np.uint64).view(np.int64)
        return pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(values)], names=["doc_id", "fp"])

    return map_batches(only(docs, "doc_id", "text"), make, "doc_id long, fp long")


def linked_pairs(distinct: DataFrame, distance: int = 2, bucket_pairs: int = 64) -> DataFrame:
    """distinct(fp) -> edges (u, v) whose components are those of the pairs at `distance` or fewer bits."""
    if distance != 2:
        raise ValueError("the segment count and the neighbour path are derived for two differing bits")
    masks, budget = ring_masks(), [distance * n // SEGMENTS for n in range(1, SEGMENTS + 1)]
    lead = max(n for n in range(1, SEGMENTS + 1) if budget[n - 1] == 0)
    keyed = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.col("fp").bitwiseAND(F.lit(_signed(masks[i][lead - 1]))).alias("key")) for i in range(SEGMENTS)])).alias("k")).select("fp", "k.at", "k.key")
    sizes = keyed.groupBy("at", "key").agg(F.count("*").alias("n")).where("n > 1")
    crowded = cut(keyed.join(sizes, ["at", "key"]))
    small = crowded.where(F.col("n") <= bucket_pairs).select("at", "key", "fp")
    a, b = small.alias("a"), small.alias("b")
    differing = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    within = F.col("a.fp") < F.col("b.fp")
    for n in range(lead + 1, SEGMENTS + 1):
        mask = F.element_at(F.array(*[F.lit(_signed(masks[i][n - 1])) for i in range(SEGMENTS)]), F.col("a.at") + 1)
        within &= F.bit_count(differing.bitwiseAND(mask)) <= budget[n - 1]
    pairs = a.join(b, (F.col("a.at") == F.col("b.at")) & (F.col("a.key") == F.col("b.key")) & within).select(F.col("b.fp").alias("u"), F.col("a.fp").alias("v"))
    large = crowded.where(F.col("n") > bucket_pairs).select("fp").distinct()
    near = large.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)])).alias("hub"))
    stars = near.select("fp", F.min("fp").over(Window.partitionBy("hub")).alias("least")).where("fp <> least").select(F.col("fp").alias("u"), F.col("least").alias("v"))
    return pairs.union(stars)


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 2) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fp, component_id, root): the smallest doc_id reachable over links, and the group's own id."""
    prints = cut(fingerprints(docs, width))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")))
    stars = component_stars(linked_pairs(distinct.select("fp"), distance))
    rooted = distinct.join(stars.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_doc", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    return spread_join(prints, rooted.select("fp", "root").join(ids, "root").select("fp", "component_id", "root"), "fp")


def keep_documents(docs: DataFrame, kept: DataFrame, mark: Column | None = None) -> DataFrame:
    """The rows of docs whose doc_id and text's mark are kept(doc_id, mark), one for each; rows without a doc_id cannot be told apart and stay.

    The mark tells texts of one doc_id apart; without it the rows of a doc_id are one document. The columns of docs travel as one, so names of theirs clash with
    none in here.
    """
    marks = F.lit(0).cast("long") if mark is None else mark
    kept = kept.select("doc_id", marks.alias("mark")) if mark is None else kept
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("doc_id"), marks.alias("mark"), F.xxhash64(*[docs[c] for c in docs.columns]).alias("h"))
    order = Window.partitionBy("doc_id", "mark").orderBy("h")
    first = rows.where("doc_id is not null").join(kept, ["doc_id", "mark"], "left_semi").withColumn("rank", F.row_number().over(order)).where("rank = 1")
    return first.select("row.*").unionByName(docs.where(docs["doc_id"].isNull()))


def keep_first(docs: DataFrame, width: int = 3, distance: int = 2) -> DataFrame:
    """One document of each group of linked fingerprints, with its columns: the one of smallest doc_id. Of one doc_id with
    several texts, those of different groups all stay where each is its group's first."""
    some = docs.where("doc_id is not null")
    kept = near_duplicates(some, width, distance).groupBy("root").agg(F.min(F.struct("doc_id", "fp")).alias("first")).select("first.doc_id", F.col("first.fp").alias("mark"))

    @F.arrow_udf("long")
    def mark(text: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t, width) for t in binary(text)], dtype=np.uint64).view(np.int64))

    return keep_documents(docs, kept, mark(docs["text"]))


def hex16(column: str):
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))
