"""Canonical exact digests of documents, and the edited-text probe built on them.

A text's canonical form is NFKC, case-folded, its white space runs one space each, trimmed. The fingerprint
is the 128-bit XXH3 of that form. Equal digests are not trusted: the canonical bytes of every bucket with
two or more members are compared, and a bucket that holds different forms gets an ordinal behind the digest
of each, in byte order.

The bytes of a text are only moved where its digest is shared. Shared digests are found from the digests
alone; a bitmap over their hashes, of eight cells for each up to 8 MB, then tells each task, with no join,
which texts may be shared. The bitmap has false positives and no false negatives: beyond its bound, at some
ten million shared digests and more, it costs traffic and not results.
Copies collapse in each task before the exchange.

Null text counts as empty. A repeated doc_id is ordered by its text; a null doc_id comes first.
"""

from __future__ import annotations

import hashlib
import math
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideloom.functions.cuts import cut
from tideloom.llm.common import map_batches

Digest = Callable[[bytes], str]
MOST_BUCKETS = 10_000
MOST_BITS = 26  # 8 MB


def canonical(text: str | None) -> bytes:
    """NFKC after case folding may itself fold again, so both are applied until a pass changes nothing."""
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.casefold()
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(text.split()).encode("utf-8")


def wide_digest(form: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(form)


def _pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def shared_bitmap(digests: DataFrame, most_bits: int = MOST_BITS) -> np.ndarray:
    """One bit for each hash cell of a digest that two or more rows have: eight cells a shared digest, 2 ** most_bits in all at most."""
    shared = cut(digests.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select(F.xxhash64("digest").alias("h")))
    bits = max(6, min(most_bits, math.ceil(math.log2(8 * max(1, shared.count())))))
    cell = F.pmod("h", F.lit(1 << bits))
    words = shared.select(cell.alias("c")).groupBy(F.expr("c div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(c % 64 as int))")).alias("set"))
    found = np.zeros((1 << bits) // 64, dtype=np.int64)
    for r in words.collect():
        found[r["word"]] = r["set"]
    return found


def colliding_forms(docs: DataFrame, digest: Digest = wide_digest, most_bits: int = MOST_BITS) -> DataFrame:
    """Digests whose documents differ in canonical bytes: (digest, form, ordinal). Byte-compares every shared bucket."""

    def narrow(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([pa.array([digest(canonical(t)) for t in batch.column(0).to_pylist()], pa.string())], names=["digest"])

    texts = docs.select(docs["text"])
    marked = shared_bitmap(map_batches(texts, narrow, "digest string"), most_bits)
    mask = 64 * len(marked) - 1

    def forms(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, packed = [], []
        for t in batch.column(0).to_pylist():
            form = canonical(t)
            key = digest(form)
            cell = xxhash.xxh64_intdigest(key.encode(), 42) & mask
            if marked[cell >> 6] >> np.int64(cell & 63) & 1:
                keys.append(key), packed.append(_pack(form))
        return pa.record_batch([pa.array(keys, pa.string()), pa.array(packed, pa.binary())], names=["digest", "form"])

    kinds = map_batches(texts, forms, "digest string, form binary").groupBy("digest", "form").agg(F.count("*").alias("n"))
    several = kinds.groupBy("digest").agg(F.count("*").alias("forms")).where("forms > 1")
    return kinds.join(several, "digest").select("digest", "form", (F.row_number().over(Window.partitionBy("digest").orderBy("form")) - 1).alias("ordinal"))


def fingerprint_edits(docs: DataFrame, digest: Digest = wide_digest, most_bits: int = MOST_BITS, bucket_rows: int = 8192) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text is the document with its last floor(n / 2) code points replaced by as many from the start
    of the next document in doc_id order (or all of it); the last document's next is the first. Likeness of
    exact fingerprints is 1 where the canonical bytes are equal and 0 elsewhere.

    Documents are dealt once, to buckets of consecutive doc_ids; the first document of a bucket goes to the
    bucket before it too. Bucket bounds are quantiles and the first ids are one row a bucket; there are at most
    MOST_BUCKETS, and a bucket is streamed, so neither the driver nor a task holds what grows with the input.
    """
    colliding = colliding_forms(docs, digest, most_bits)
    if not colliding.isEmpty():
        return _with_ordinals(_edits(docs, digest, bucket_rows, keep_forms=True), colliding)
    return _edits(docs, digest, bucket_rows, keep_forms=False)


def _bounds(ids: DataFrame, buckets: int) -> list[int]:
    if buckets <= 1:
        return []
    cut = ids.approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 0.25 / buckets)
    return sorted({int(x) for x in cut})


def _edits(docs: DataFrame, digest: Digest, bucket_rows: int, keep_forms: bool) -> DataFrame:
    ids = docs.select(docs["doc_id"].cast("long").alias("doc_id"))
    count = ids.count()
    bounds = _bounds(ids.where("doc_id is not null"), min(MOST_BUCKETS, max(1, -(-count // bucket_rows))))

    def bucket_of(values: pa.Array) -> np.ndarray:
        known = values.fill_null(0).to_numpy(zero_copy_only=False)
        return np.where(values.is_null().to_numpy(zero_copy_only=False), 0, np.searchsorted(np.array(bounds, dtype=np.int64), known, side="right"))

    def numbered(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([pa.array(bucket_of(batch.column(0)).astype(np.int32)), batch.column(0)], names=["bucket", "doc_id"])

    heads = map_batches(ids, numbered, "bucket int, doc_id long").groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("doc_id"))).alias("head")).select("bucket", "head.doc_id").collect()
    order = sorted(r["bucket"] for r in heads)
    before = {bucket: order[i - 1] for i, bucket in enumerate(order)}
    head_of = {r["doc_id"]: before[r["bucket"]] for r in heads}

    def dealt(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc_id, bucket, text in zip(batch.column(0).to_pylist(), bucket_of(batch.column(0)).tolist(), batch.column(1).to_pylist(), strict=True):
            raw = (text or "").encode("utf-8")
            packed, tie = _pack(raw), xxhash.xxh3_64_intdigest(raw) >> 1
            rows.append((bucket, False, doc_id, tie, packed))
            if doc_id in head_of:
                rows.append((head_of[doc_id], True, doc_id, tie, packed))
        cols = list(zip(*rows, strict=True)) or [[], [], [], [], []]
        kinds = (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["bucket", "guest", "doc_id", "tie", "packed"])

    placed = map_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]), dealt, "bucket int, guest boolean, doc_id long, tie long, packed binary")
    tasks = len(bounds) + 1
    rows = placed.repartitionById(tasks, "bucket").sortWithinPartitions("bucket", "guest", F.col("doc_id").asc_nulls_first(), "tie")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if keep_forms:
        schema += ", form binary, edited_form binary"

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        held: tuple | None = None
        closed = None  # the bucket that has met its guest
        for batch in batches:
            out = []
            for bucket, guest, doc_id, packed in zip(*[batch.column(i).to_pylist() for i in (0, 1, 2, 4)], strict=True):
                if bucket == closed:  # further rows of the guest's doc_id
                    continue
                text = unpack.decompress(packed).decode("utf-8")
                form = canonical(text)
                new = (doc_id, text, form, digest(form))
                if held:
                    out.append(_edited(held, new, digest, keep_forms))
                held, closed = (None, bucket) if guest else (new, None)
            yield pa.RecordBatch.from_pydict({n: [r[i] for r in out] for i, n in enumerate(_names(keep_forms))}, schema=_arrow(keep_forms))

    return rows.mapInArrow(finish, schema)


def _names(keep_forms: bool) -> list[str]:
    return ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"] + ["form", "edited_form"] * keep_forms


def _arrow(keep_forms: bool) -> pa.Schema:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.binary(), pa.binary()]
    return pa.schema(list(zip(_names(keep_forms), kinds, strict=False)))


def _edited(own: tuple, following: tuple, digest: Digest, keep_forms: bool) -> tuple:
    doc_id, text, form, key = own
    half = len(text) // 2
    edited = text[: len(text) - half] + following[1][:half]
    edited_form = canonical(edited)
    row = (doc_id, len(text), hashlib.sha256(edited.encode("utf-8")).hexdigest(), key, digest(edited_form), float(form == edited_form), float(form == following[2]))
    return (*row, _pack(form), _pack(edited_form)) if keep_forms else row


def _with_ordinals(edits: DataFrame, colliding: DataFrame) -> DataFrame:
    """Ordinals behind colliding digests. An edited text that no document equals gets one of its own, `x`."""
    own = colliding.select(F.col("digest").alias("fingerprint"), "form", F.col("ordinal").alias("a"))
    other = colliding.select(F.col("digest").alias("edited_fingerprint"), F.col("form").alias("edited_form"), F.col("ordinal").alias("b"))
    known = colliding.select(F.col("digest").alias("edited_fingerprint"), F.lit(True).alias("c")).distinct()
    joined = edits.join(own, ["fingerprint", "form"], "left").join(other, ["edited_fingerprint", "edited_form"], "left").join(known, "edited_fingerprint", "left")
    first = F.when(F.col("a").isNull(), F.col("fingerprint")).otherwise(F.concat_ws("-", "fingerprint", "a"))
    second = F.when(F.col("b").isNotNull(), F.concat_ws("-", "edited_fingerprint", "b")).when(F.col("c"), F.concat_ws("-", "edited_fingerprint", F.lit("x"))).otherwise(F.col("edited_fingerprint"))
    return joined.select("doc_id", "n_chars", "edited_sha256", first.alias("fingerprint"), second.alias("edited_fingerprint"), "near_edited", "near_next")
