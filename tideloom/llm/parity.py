"""Jaccard join of word shingles by parity sketches.

A document's set of shingles is hashed into a sketch of k segments: each shingle flips one bit of one segment,
so bits are parities (XOR) and the Hamming distance of two sketches is at most the size of the sets' symmetric
difference. Two sets of a and b shingles whose Jaccard similarity is `percent` / 100 or more differ in at most
D = floor((a + b) (100 - percent) / (100 + percent)) shingles, so at most D segments differ. A segment is very
wide and nearly empty; it is held as one 64-bit key of its set bits.

Size bands. Band i holds the sizes from 2^i to 2^(i+1) - 1 and fixes k; a set whose size may be similar to one of
the next band goes there too. All non-empty segments of a set are keys of the join: of X of them X - D or more
are shared with every partner in the band (pigeonhole). Where a band's hash leaves a small set fewer than D + 1
non-empty segments, further hashes follow until one does; of two sets the one that stops first has D + 1 there
and the other is there too, so no pair is lost.

Common keys. A key of more than CROWD texts is not paired off. A set all of whose partners must share a key
that is not crowded (X - D less its crowded keys is 1 or more) needs none of its crowded keys. Two sets that both
lack that proof are linked to the first text of each crowded key, which puts them into one cluster. Pairs of
keys that are not crowded are pruned by size and by a second, dense sketch of 512 bits, whose Hamming distance
is a lower bound too. So every pair at the threshold lies within a cluster. A cluster's texts are dealt into blocks
and compared by their shingle sets within each; what lies in two blocks meets by wider parity sketches (2 to 4 bits a
shingle), and only pairs whose distance allows the threshold are compared by their sets. Nothing is capped.

Crowded keys are put together in each batch before the exchange: a key that more than CROWD texts of a batch
have leaves it as one row, and its texts keep the name of the batch's first text. Exact copies collapse by the
64-bit id of their words: at 3e10 different texts some 24 pairs of ids are expected to coincide.

A text of fewer words than a shingle is one shingle of all its words. Null, empty and blank texts have no
shingle, are linked with nothing and are components of their own. Repeated rows are copies. A null doc_id is a
component's id only where it has no other. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideloom.functions.cuts import cut
from tideloom.llm.common import binary, map_batches, only, spread_join, word_chunks
from tideloom.llm.components import SMALL_GRAPH
from tideloom.llm.similar import link_clusters, texts_of

CROWD = 8
DENSE_BITS = 512
BAND_MASK = 127  # the low bits of a key name its band
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * _C[4]
    x = (x ^ (x >> np.uint64(33))) * _C[5]
    return x ^ (x >> np.uint64(33))


def shingle_set(text: bytes, width: int = 5) -> np.ndarray:
    """The distinct 64-bit values of a lower-cased text's shingles, sorted; none without words.

    A shingle's value is a mixed sum of its words' hashes, each times an odd factor of its place.
    """
    parts = [np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words)) for words in word_chunks(text)]
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    words = np.concatenate(parts)
    span = min(width, len(words))
    found = np.full(len(words) - span + 1, span, dtype=np.uint64)
    for i in range(span):
        found += words[i : len(words) - span + 1 + i] * (_C[i % len(_C)] + np.uint64(2 * (i // len(_C))))
    found = _mixed(found)
    found.sort()
    return found[np.r_[True, found[1:] != found[:-1]]]


def text_id(text: bytes) -> int:
    """64 bits of a digest of the lower-cased words, one space between them."""
    digest = xxhash.xxh3_64()
    for words in word_chunks(text.lower()):
        digest.update(b" ".join(words) + b" ")
    return digest.intdigest() - (1 << 63)


def most_differing(a: int, b: int, percent: int) -> int:
    """The largest symmetric difference of sets of a and b values that are similar enough."""
    return (a + b) * (100 - percent) // (100 + percent)


def segments_of(band: int, percent: int) -> int:
    """The segments of a band: 1.35 for each shingle that two sets of its largest size may differ in, 16 at least."""
    return max(16, -(-27 * most_differing(2 << band, 2 << band, percent) // 20))


def segment_keys(tokens: np.ndarray, band: int, level: int, segments: int) -> np.ndarray:
    """A key for each non-empty segment of the set's sketch."""
    at = _mixed(tokens * _C[1] + np.uint64(2 * (band + 64 * level) + 1))
    segment = (at >> np.uint64(32)) % np.uint64(segments)
    order = np.argsort(segment, kind="stable")
    segment, bits = segment[order], _mixed(at[order] * _C[2])
    first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
    keys = _mixed(np.bitwise_xor.reduceat(bits, first) + segment[first] * _C[3] + np.uint64(band + 64 * level))
    return (keys & ~np.uint64(BAND_MASK)) | np.uint64(band)


def band_keys(tokens: np.ndarray, percent: int) -> tuple[np.ndarray, list[int], list[int]]:
    """(keys, bands, slacks) of a set. A slack is how many crowded keys the set may have and still be sure of one that is
    not, with every partner of that band; -1 if it took several hashes."""
    n = len(tokens)
    own = n.bit_length() - 1
    keys, bands, slacks = [], [], []
    for band in (own, own + 1):
        largest = min(100 * n // percent, (2 << band) - 1)
        if largest < 1 << band:
            continue
        differing = most_differing(n, largest, percent)
        level = 0
        while True:
            found = segment_keys(tokens, band, level, segments_of(band, percent))
            keys.append(found)
            if len(found) > differing:
                break
            level += 1
        bands.append(band)
        slacks.append(len(found) - differing - 1 if level == 0 else -1)
    return np.concatenate(keys), bands, slacks


def dense_sketch(tokens: np.ndarray) -> list[int]:
    """512 parities of the set as eight longs."""
    flips = np.bincount((tokens * _C[3]) >> np.uint64(55), minlength=DENSE_BITS) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view("<i8").tolist()


_SKETCH = pa.schema([("doc_id", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("size", pa.int64()), ("dense", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())), ("crowded", pa.list_(pa.int64())), ("hubs", pa.list_(pa.struct([("band", pa.int32()), ("hub", pa.int64())]))), ("slacks", pa.list_(pa.struct([("band", pa.int32()), ("slack", pa.int32())])))])
_SKETCH_SQL = "doc_id long, id long, n long, size long, dense array<long>, keys array<long>, crowded array<long>, hubs array<struct<band: int, hub: long>>, slacks array<struct<band: int, slack: int>>"


def sketches(docs: DataFrame, percent: int, width: int, crowd: int) -> DataFrame:
    """docs(doc_id, text) -> one row a document. A text's first row in its task has its keys: `keys` that few texts of the
    batch share, `crowded` those it stands for as the batch's first text, `hubs` the first texts of its other ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            rows, found, owners = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), binary(batch.column(1)), strict=True):
                data = (text or b"").lower()
                tokens = shingle_set(data, width)
                name = text_id(data)
                row = {"doc_id": doc_id, "id": name, "n": len(tokens), "size": len(data), "dense": None, "keys": None, "crowded": None, "hubs": None, "slacks": None}
                if len(tokens) and name not in seen:
                    seen.add(name)
                    keys, bands, slacks = band_keys(tokens, percent)
                    row |= {"dense": dense_sketch(tokens), "hubs": [], "slacks": [{"band": b, "slack": s} for b, s in zip(bands, slacks, strict=True)]}
                    found.append(keys), owners.append(np.full(len(keys), len(rows)))
                rows.append(row)
            if found:
                _deal(rows, np.concatenate(found), np.concatenate(owners), crowd)
            yield pa.RecordBatch.from_pylist(rows, schema=_SKETCH)

    return only(docs.withColumn("doc_id", docs["doc_id"].cast("long")), "doc_id", "text").mapInArrow(run, _SKETCH_SQL)


def _deal(rows: list[dict], keys: np.ndarray, owners: np.ndarray, crowd: int) -> None:
    """Puts each key of a batch into its texts' rows."""
    _, at, counts = np.unique(keys, return_inverse=True, return_counts=True)
    many = counts[at] > crowd
    few = ~many
    single, starts = owners[few], np.searchsorted(owners[few], np.arange(len(rows) + 1))
    signed = keys.view(np.int64)
    plain = signed[few]
    for i in np.unique(single).tolist():
        rows[i]["keys"] = plain[starts[i] : starts[i + 1]]
    first: dict[int, int] = {}
    for k, i, key, band in zip(at[many].tolist(), owners[many].tolist(), signed[many].tolist(), (keys[many] & np.uint64(BAND_MASK)).tolist(), strict=True):
        hub = first.setdefault(k, i)
        if hub == i:
            rows[i]["crowded"] = (rows[i]["crowded"] or []) + [key]
        else:
            rows[i]["hubs"].append({"band": band, "hub": rows[hub]["id"]})


PAIR, MEMBER, STAND_IN = 0, 1, 2


def met_keys(sketched: DataFrame, crowd: int) -> DataFrame:
    """(kind, u, v, band): PAIR of texts of a key that is not crowded; MEMBER u of a crowded key whose first text is v; STAND_IN
    u, which stands for texts of its batch, likewise. One exchange of (key, id); a key's rows stream by in order."""
    rows = sketched.select("id", F.explode("keys").alias("key"), F.lit(1).alias("few")).union(sketched.select("id", F.explode("crowded"), F.lit(0)))
    ordered = rows.repartition("key").sortWithinPartitions("key", "few", "id")
    schema = pa.schema([("kind", pa.int32()), ("u", pa.int64()), ("v", pa.int64()), ("band", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))  # the last key's rows so far, `crowd` + 2 at most
        hub = None  # its first text, if the key is known to be crowded

        def close(keys: np.ndarray, ids: np.ndarray, few: np.ndarray, ends: list[int], starts: list[int]) -> None:
            for a, b in zip(starts, ends, strict=True):
                group = ids[a:b]
                if few[a] and len(group) <= crowd:
                    kinds = sorted(set(group.tolist()))
                    out.extend((PAIR, u, v, 0) for i, u in enumerate(kinds) for v in kinds[i + 1 :])
                else:
                    crowded(int(keys[a]), group, few[a:b], int(group[0]))

        def crowded(key: int, group: np.ndarray, few: np.ndarray, first: int) -> None:
            out.extend((MEMBER if f else STAND_IN, u, first, key & BAND_MASK) for u, f in zip(group.tolist(), few.tolist(), strict=True))

        for batch in batches:
            ids, keys, few = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if hub is not None:
                run_on = int(np.searchsorted(keys, hub[0], side="right")) if len(keys) and keys[0] == hub[0] else 0
                crowded(hub[0], ids[:run_on], few[:run_on], hub[1])
                ids, keys, few = ids[run_on:], keys[run_on:], few[run_on:]
                hub = None if len(keys) else hub
            keys, ids, few = (np.concatenate([h, x]) for h, x in zip(held, (keys, ids, few), strict=True))
            held = (keys[:0], ids[:0], few[:0])
            if len(keys):
                starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
                several = np.flatnonzero(np.diff(starts) > 1) if len(starts) > 1 else np.zeros(0, np.int64)
                lone = np.flatnonzero((np.diff(starts) == 1) & (few[starts[:-1]] == 0)) if len(starts) > 1 else np.zeros(0, np.int64)
                whole = np.sort(np.concatenate([several, lone]))
                close(keys, ids, few, starts[whole + 1].tolist(), starts[whole].tolist())
                last = int(starts[-1])
                if len(set(ids[last:].tolist())) > crowd or not few[last]:
                    hub = (int(keys[last]), int(ids[last]))
                    crowded(hub[0], ids[last:], few[last:], hub[1])
                else:
                    _, once = np.unique(ids[last:], return_index=True)
                    held = tuple(x[last:][once] for x in (keys, ids, few))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out.clear()
        close(held[0], held[1], held[2], [len(held[0])] if len(held[0]) > 1 else [], [0] if len(held[0]) > 1 else [])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return ordered.mapInArrow(run, "kind int, u long, v long, band int")


def candidate_links(sketched: DataFrame, texts: DataFrame, percent: int, crowd: int) -> DataFrame:
    """(u, v): links whose components hold every pair at the threshold. texts(id, n, dense) has a row an id."""
    met = cut(met_keys(sketched, crowd))
    a, b = (texts.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("dense").alias(f"d{x}")) for x in "uv")
    pairs = met.where(F.col("kind") == PAIR).select("u", "v").distinct().join(a, "u").join(b, "v")
    least, most = F.least("nu", "nv"), F.greatest("nu", "nv")
    apart = sum((F.bit_count(F.col("du")[i].bitwiseXOR(F.col("dv")[i])) for i in range(DENSE_BITS // 64)), F.lit(0))
    near = pairs.where((100 * least >= percent * most) & (apart * (100 + percent) <= (F.col("nu") + F.col("nv")) * (100 - percent))).select("u", "v")
    in_batch = sketched.select("id", F.explode("hubs").alias("h")).select(F.col("id").alias("u"), F.col("h.hub").alias("v"), "h.band")
    members = in_batch.union(met.where(F.col("kind") == MEMBER).select("u", "v", "band"))
    crowded = met.where(F.col("kind") != PAIR).select("u", "v", "band").union(in_batch).groupBy("u", "band").agg(F.count("*").alias("crowded"))
    slacks = sketched.select(F.col("id").alias("u"), F.explode("slacks").alias("s")).select("u", "s.*").groupBy("u", "band").agg(F.min("slack").alias("slack"))
    unsure = crowded.join(slacks, ["u", "band"]).where("crowded > slack").select("u", "band")
    links = members.join(unsure, ["u", "band"], "left_semi").select("u", "v").union(met.where(F.col("kind") == STAND_IN).select("u", "v"))
    return near.union(links.where("u <> v")).distinct()


def wide_sketch(tokens: np.ndarray) -> bytes:
    """2 to 4 parities for each value of the set, a power of two in all; folding the halves gives the sketch of half the width."""
    bits = max(DENSE_BITS, 2 << len(tokens).bit_length())
    flips = np.bincount((tokens * _C[3]) & np.uint64(bits - 1), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def _folded(sketch: np.ndarray, words: int) -> np.ndarray:
    while sketch.shape[-1] > words:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def _near_sketches(group: pa.Table, percent: int) -> pa.Table:
    """Pairs of an asking and another row that lie in two blocks and two parts and whose sizes and sketches allow the similarity."""
    cols = {name: group.column(name).to_numpy(zero_copy_only=False) for name in ("id", "block", "part", "n", "asks")}
    bits = [np.frombuffer(b, dtype=np.uint64) for b in group.column("bits").to_pylist()]
    found: list[tuple[int, int, float]] = []
    widths = np.array([len(b) for b in bits])
    for width in np.unique(widths).tolist():
        there = np.flatnonzero((widths == width) & ~cols["asks"])
        if not len(there):
            continue
        sketches = np.stack([bits[i] for i in there])
        for u in np.flatnonzero(cols["asks"]).tolist():
            n, m = int(cols["n"][u]), cols["n"][there]
            fits = np.flatnonzero((100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (cols["part"][there] != cols["part"][u]) & (cols["block"][there] != cols["block"][u]))
            for at in range(0, len(fits), 4096):
                some = fits[at : at + 4096]
                common = min(width, len(bits[u]))
                apart = np.bitwise_count(_folded(sketches[some], common) ^ _folded(bits[u], common)).sum(axis=1, dtype=np.int64)
                size = n + m[some]
                for k in np.flatnonzero(apart * (100 + percent) <= size * (100 - percent)).tolist():
                    v = int(cols["id"][there[some[k]]])
                    found.append((min(int(cols["id"][u]), v), max(int(cols["id"][u]), v), float(apart[k] / size[k])))
    return pa.table([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["u", "v", "apart"])


def meet_by_sketches(members: DataFrame, whole: DataFrame, percent: int, width: int, block_bytes: int) -> DataFrame:
    """members(id, root, block, part), whole(id, text) -> (u, v, apart): pairs across blocks and parts of a cluster by their wide sketches.

    Only rows outside a cluster's largest part ask. Sketches, a tenth of the texts' bytes, are dealt into blocks, and
    every block of asking rows meets every block.
    """

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set((t or b"").lower(), width) for t in binary(batch.column(1))]
        return pa.record_batch([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([wide_sketch(s) for s in sets], pa.binary())], names=["id", "n", "bits"])

    drawn = cut(map_batches(only(whole, "id", "text"), make, "id long, n long, bits binary").join(members, "id"))
    largest = drawn.groupBy("root", "part").agg(F.count("*").alias("rows")).groupBy("root").agg(F.max_by("part", F.struct("rows", "part")).alias("largest"))
    size = F.sum(F.octet_length("bits") + 40) / block_bytes
    blocks = drawn.groupBy("root").agg(F.ceil(size).alias("blocks"))
    asks = drawn.join(largest, "root").where("part <> largest").drop("largest")
    asked = asks.groupBy("root").agg(F.ceil(size).alias("asked_blocks"))
    each = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
    columns = ["id", "root", "block", "part", "n", "bits"]
    asking = asks.join(blocks, "root").join(asked, "root").select(*columns, F.lit(True).alias("asks"), F.pmod(F.xxhash64("id", F.lit(1)), "asked_blocks").alias("x"), each("blocks").alias("y"))
    there = drawn.join(blocks, "root").join(asked, "root").select(*columns, F.lit(False).alias("asks"), F.pmod(F.xxhash64("id"), "blocks").alias("y"), each("asked_blocks").alias("x"))
    dealt = asking.unionByName(there).repartition("root", "x", "y")  # what lies in one partition before would be one task's
    met = dealt.groupBy("root", "x", "y").applyInArrow(lambda g: _near_sketches(g, percent), "u long, v long, apart double")
    return met.groupBy("u", "v").agg(F.min("apart").alias("apart"))


def join(docs: DataFrame, percent: int = 80, width: int = 5, crowd: int = CROWD, block_bytes: int = 2_000_000) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_shingles, component_id): links at a similarity of `percent` / 100 or more, which is 70 at least.

    Near 50 a partner may touch every segment of a set, and no hash leaves it one to share.
    """
    if not 70 <= percent <= 100:
        raise ValueError("percent must be from 70 to 100")
    drawn = cut(sketches(docs, percent, width, crowd))
    texts = cut(drawn.where("n > 0").groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.max("size").alias("size"), F.max("dense").alias("dense")))
    edges = cut(candidate_links(drawn.where("slacks is not null"), texts, percent, crowd))
    asked = texts.select("doc_id", "id").join(edges.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "id", "left_semi")
    whole = cut(texts_of(docs, cut(asked), text_id))
    linked = link_clusters(texts, edges, whole, percent / 100, width, block_bytes, lambda members, some: meet_by_sketches(members, some, percent, width, 2 * block_bytes), SMALL_GRAPH)
    rooted = texts.select("id", "doc_id").join(linked.withColumnRenamed("node", "id"), "id", "left").select("id", "doc_id", F.coalesce("root", "id").alias("root"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    some = spread_join(drawn.where("n > 0").select("doc_id", "id", "n"), rooted.select("id", "root").join(least, "root").select("id", "component_id"), "id")
    none = drawn.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return some.select("doc_id", "n", "component_id").union(none).withColumnRenamed("n", "n_shingles")
