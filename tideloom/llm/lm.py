"""Stupid-backoff language-model scores from the corpus's own n-gram counts.

The score of a word given the words before it is c(longest gram) / c(its context) for the longest gram that
ends at the word and has a count, times `discount` for each order given up; the lowest order is c(w) / N.
Grams of two words or more count from `min_count` occurrences on, so what only one place holds is backed off
from. Counts are over all documents.

The plan is relational: exploded n-grams, a count table partitioned by gram hash, a join of the two, a sum
per document. Rows are packed: texts fall in blocks of about `block_bytes`, a block's distinct grams are cut
by hash bucket, and one row holds a block's grams of one bucket (sorted 64-bit hashes and counts,
compressed). The bucket's rows from all blocks are summed to its part of the count table and matched with
each block's own grams; the counts go back to the block, which scores its texts. A frequent gram is one entry
a block however often it occurs. Blocks and buckets keep their size up to some 700 GB of text; beyond, both
grow with the root of the input, so that a packed row never holds fewer than about `row_grams` grams: rows
stay below grams / row_grams, in proportion to the input, where blocks x buckets alone would be its square.

Texts are scored once for all their copies: copies collapse within each task before they are dealt, and
within a block. A text of more than `piece_bytes` is dealt as several pieces, each with the words before it as
context, so no text sets the memory of a task. Grams are told apart by 64 hash bits, texts by SHA-256. Words
are lower-cased (A-Z) runs of other than 0x20 and 0x09-0x0D; a gram does not reach beyond its document. Null
and wordless texts have no words, log-probability 0 and a null score.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideloom.llm.common import binary, map_batches, word_chunks

_MIX = np.uint64(0x9E3779B97F4A7C15)
_REQUEST = "bucket int, block int, level int, total long, keys binary, counts binary"
_ANSWER = "block int, bucket int, level int, total long, counts binary"


def _pack(values: np.ndarray) -> bytes:
    """Unsigned 64-bit values, their bytes of equal weight together, compressed."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, sorted, and each value's place among them; as np.unique, in half its memory."""
    order = np.argsort(values, kind="stable").astype(np.int32)
    ordered = values[order]
    new = np.ones(len(values), dtype=bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    keys = ordered[new]
    del ordered
    places = np.empty(len(values), dtype=np.int32)
    places[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return keys, places


def pieces(text: bytes, most_bytes: int, context: int) -> Iterator[tuple[int, bytes]]:
    """(context words, text) of each piece of a text; the context, up to that many words, comes first and is not the piece's own."""
    if len(text) <= most_bytes:
        yield 0, text
        return
    before: list[bytes] = []
    size = max(1, most_bytes // 8)
    for words in word_chunks(text, size):
        for at in range(0, len(words), size):
            some = words[at : at + size]
            yield len(before), b" ".join(before + some)
            before = (before + some)[len(before) + len(some) - context :] if context else []


class Grams:
    """The grams of a block's pieces, one order at a time so that one order's arrays are sorted at once.

    keys[k]: distinct grams of k + 1 words, sorted; counts[k]: how often the block has them, copies included and
    those that end in a piece's context left out; places[k]: for each token the place in keys[k] of the gram that
    ends there, -1 where its piece has none.
    """

    def __init__(self, texts: list[bytes], copies: np.ndarray, contexts: np.ndarray, order: int):
        hashed = [np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words)) for t in texts for words in [[w for chunk in word_chunks(t.lower()) for w in chunk]]]
        self.lengths, self.contexts = np.array([len(h) for h in hashed], dtype=np.int64), contexts
        one = np.concatenate(hashed) if hashed else np.zeros(0, dtype=np.uint64)
        del hashed
        n = len(one)
        self.total = int((copies * (self.lengths - contexts)).sum())
        self.keys, self.counts, self.places = [], [], []
        level, valid = one, np.ones(n, dtype=bool)
        starts = np.concatenate([[0], np.cumsum(self.lengths)])
        first = np.zeros(n + 1, dtype=bool)
        first[starts] = True
        first = first[:n]
        weight = np.repeat(copies, self.lengths) if copies.max(initial=1) > 1 or contexts.any() else None
        for i in np.flatnonzero(contexts).tolist():
            weight[starts[i] : starts[i] + contexts[i]] = 0
        for k in range(order):
            if k:
                before = np.roll(level, 1)
                before *= _MIX
                before += one
                before += np.uint64(k)
                level = _mixed(before)
                valid = np.roll(valid, 1) & ~first
                del before
            keys, inverse = _ranked(level[valid])
            counts = np.bincount(inverse, weights=None if weight is None else weight[valid], minlength=len(keys))
            spots = np.full(n, -1, dtype=np.int32)
            spots[valid] = inverse
            self.keys.append(keys)
            self.counts.append(counts.astype(np.uint64))
            self.places.append(spots)
            del inverse, counts

    def slices(self, bits: int):
        """(order, bucket, from, to) of the keys by their leading bits."""
        for k, keys in enumerate(self.keys):
            heads = (keys >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(keys), dtype=np.int32)
            cuts = np.flatnonzero(np.diff(heads)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(heads)], strict=True):
                if b > a:
                    yield k, int(heads[a]), a, b

    def score(self, counts: list[np.ndarray], total: int, discount: float, min_count: int) -> list[tuple[int, float, list[int]]]:
        """(words, log-probability, words scored by each order) of every piece; counts are the corpus's, by place in keys."""
        n, order = int(self.lengths.sum()), len(self.places)
        log_p, level = np.zeros(n), np.zeros(n, dtype=np.int8)
        allowed = np.zeros(n, dtype=np.int8)  # orders that the document's own beginning allows
        for p in self.places:
            allowed += p >= 0
        waits = np.ones(n, dtype=bool)

        def of(k: int) -> np.ndarray:
            return np.where(self.places[k] >= 0, counts[k][self.places[k]], 0) if len(counts[k]) else np.zeros(n)

        for k in range(order - 1, -1, -1):
            own = of(k)
            hit = waits & (own >= min_count) if k else waits & (own > 0)
            context = np.roll(of(k - 1), 1) if k else np.full(n, max(total, 1))
            log_p[hit] = np.log(own[hit]) - np.log(context[hit])
            level[hit] = k
            waits &= ~hit
        log_p += (allowed - 1 - level) * math.log(discount)
        ends = np.cumsum(self.lengths)
        tallies = [np.concatenate([[0], np.cumsum(level == k)]) for k in range(order)]
        return [(b - a, float(log_p[a:b].sum()), [int(t[b] - t[a]) for t in tallies]) for a, b in zip((ends - self.lengths + self.contexts).tolist(), ends.tolist(), strict=True)]


def _texts(block: pa.Table) -> tuple[list[tuple[str, int]], list[bytes], np.ndarray, np.ndarray]:
    """The block's distinct pieces by digest and place, how many documents have each, and their context words."""
    unpack = zstandard.ZstdDecompressor()
    held: dict[tuple[str, int], list] = {}
    for digest, piece, context, text, n in zip(*[block.column(c).to_pylist() for c in ("digest", "piece", "context", "packed", "copies")], strict=True):
        held.setdefault((digest, piece), [text, context, 0])[2] += n
    order = sorted(held)
    return order, [unpack.decompress(held[k][0]) for k in order], np.array([held[k][2] for k in order], dtype=np.int64), np.array([held[k][1] for k in order], dtype=np.int64)


def block_and_bucket(size: int, block_bytes: int, bucket_bytes: int, row_grams: int) -> tuple[int, int]:
    """The two sizes, raised alike where a block's grams of a bucket would be fewer than row_grams on average, at six bytes a word."""
    least = math.sqrt(6 * row_grams * size / (block_bytes * bucket_bytes))
    return int(block_bytes * max(1.0, least)), int(bucket_bytes * max(1.0, least))


def score(docs: DataFrame, order: int = 3, discount: float = 0.4, min_count: int = 2, block_bytes: int = 16_000_000, bucket_bytes: int = 8_000_000, row_grams: int = 32, piece_bytes: int = 1_000_000) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_words, log_prob, score, and n_order1 .. words scored by each order); score is log_prob / n_words."""
    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    size = plain.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    block_bytes, bucket_bytes = block_and_bucket(size, block_bytes, bucket_bytes, row_grams)
    blocks = max(1, -(-size // block_bytes))
    bits = max(0, math.ceil(math.log2(max(1, size / bucket_bytes))))

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = zstandard.ZstdCompressor(level=3)
        counts: dict[str, int] = {}
        parts: dict[str, list[tuple[int, bytes]]] = {}
        for text in binary(batch.column(0)):
            digest = hashlib.sha256(text).hexdigest()
            if digest not in counts:
                counts[digest], parts[digest] = 0, [(n, coder.compress(part)) for n, part in pieces(text, piece_bytes, order - 1)]
            counts[digest] += 1
        rows = [((int(d[:15], 16) + i) % blocks, d, i, context, part, counts[d]) for d, found in parts.items() for i, (context, part) in enumerate(found)]
        kinds = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.int64())
        cols = list(zip(*rows, strict=True)) or [[] for _ in kinds]
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["block", "digest", "piece", "context", "packed", "copies"])

    def request(block: pa.Table) -> pa.Table:
        """The block's grams by order and bucket, and its number of words, which goes to every block through bucket 0."""
        _, texts, copies, contexts = _texts(block)
        grams = Grams(texts, copies, contexts, order)
        name = block.column("block")[0].as_py()
        rows = [(b, name, k, 0, _pack(np.diff(grams.keys[k][a:z], prepend=np.uint64(0))), _pack(grams.counts[k][a:z])) for k, b, a, z in grams.slices(bits)]
        rows.append((0, name, -1, grams.total, b"", b""))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "block", "level", "total", "keys", "counts"])

    def count(bucket: pa.Table) -> pa.Table:
        levels, answers, totals = bucket.column("level").to_pylist(), [b""] * bucket.num_rows, [0] * bucket.num_rows
        n = sum(bucket.column("total").to_pylist())
        packed, own = bucket.column("keys"), bucket.column("counts")
        for level in sorted(set(levels)):
            rows = [i for i, x in enumerate(levels) if x == level]
            if level < 0:
                for i in rows:
                    totals[i] = n
                continue
            keys = [np.cumsum(_unpack(packed[i].as_py()), dtype=np.uint64) for i in rows]
            sizes = [len(k) for k in keys]
            _, inverse = _ranked(np.concatenate(keys))
            del keys
            sums = np.bincount(inverse, weights=np.concatenate([_unpack(own[i].as_py()) for i in rows])).astype(np.uint64)
            at = 0
            for i, size in zip(rows, sizes, strict=True):
                answers[i] = _pack(sums[inverse[at : at + size]])
                at += size
        return pa.table([bucket.column("block"), bucket.column("bucket"), bucket.column("level"), pa.chunked_array([pa.array(totals, pa.int64())]), pa.chunked_array([pa.array(answers, pa.binary())])], names=["block", "bucket", "level", "total", "counts"])

    names = ["digest", "n_words", "log_prob", *[f"n_order{k}" for k in range(1, order + 1)]]

    def finish(block: pa.Table, answers: pa.Table) -> pa.Table:
        kinds = [pa.string(), pa.int64(), pa.float64()] + [pa.int64()] * order
        if not block.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        places_of, texts, copies, contexts = _texts(block)
        grams = Grams(texts, copies, contexts, order)
        del texts
        places = {(k, b): i for i, (k, b) in enumerate(zip(answers.column("level").to_pylist(), answers.column("bucket").to_pylist(), strict=True))}
        told = answers.column("counts")
        counts: list[list[np.ndarray]] = [[] for _ in range(order)]
        for k, b, _, _ in grams.slices(bits):
            counts[k].append(_unpack(told[places[k, b]].as_py()))
        total = answers.column("total")[places[-1, 0]].as_py()
        scores = grams.score([np.concatenate(c) if c else np.zeros(0, dtype=np.uint64) for c in counts], total, discount, min_count)
        rows = [(d, n, p, *tally) for (d, _), (n, p, tally) in zip(places_of, scores, strict=True)]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    dealt = map_batches(plain.select("text"), deal, "block int, digest string, piece int, context int, packed binary, copies long").repartition(blocks, "block")
    asked = dealt.groupBy("block").applyInArrow(request, _REQUEST)
    told = asked.groupBy("bucket").applyInArrow(count, _ANSWER)
    tallies = ", ".join(f"n_order{k} long" for k in range(1, order + 1))
    scored = dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(finish, f"digest string, n_words long, log_prob double, {tallies}")
    scored = scored.groupBy("digest").agg(*[F.sum(n).alias(n) for n in names[1:]])  # of a text's pieces
    named = plain.select("doc_id", F.sha2("text", 256).alias("digest"))
    mean = F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words"))
    return named.join(scored, "digest").select("doc_id", "n_words", "log_prob", mean.alias("score"), *names[3:])
