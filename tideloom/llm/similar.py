"""SimHash near-dedup carried on to edited copies: similarity of five-word shingles of 0.8 or more.

Texts first meet by their SimHash fingerprints, through the pigeonring chains and the Hamming check of simhash.py:
every link at two or fewer differing bits is a candidate here. Sums of shingle bits cannot index what lies beyond: a
pair of similarity 0.8 differs in about ten of 64 sign bits, and no key that survives ten differing bits is selective.
For those pairs a second ring has min-wise boxes: box i holds the least value of hash i over the shingles, and its
print has one bit of each. Equal boxes give equal bits, and two texts of similarity s agree in a box
with probability s. The filter is the pigeonring one of simhash.py: 63 boxes form a ring of 21 segments, and
where at most 20 boxes differ, some segment starts chains of l segments that differ in floor(20 l / 21) boxes
at most for every l. For l = 1 that is none, so a segment's three boxes are an exact key; the bits prune the
longer chains before the full Hamming check. A pair of similarity 0.8 shares no segment with probability
(1 - 0.8 ** 3) ** 21, 3 in ten million.

The texts of a min-wise key are not paired off: each is filtered against the least and the greatest id among them, so
candidates are in proportion to the keys. A key of up to three texts is paired
whole by that, and a larger one loses a pair only if one of the two fails the filter against both ends of
every key they share. The candidates of both rings gather clusters. Within a cluster every pair is compared by its
shingle sets, so links there are exact:

1. A cluster is dealt into blocks of about `block_bytes` of text by a hash of the id. Every block also gets the
   cluster's two leaders, its least text and that of most candidates. A task links one block.
2. Links are joined. Where a cluster has several blocks, the texts outside its largest component are dealt
   into blocks of their own, each of which meets every block of the cluster. Two texts of one component need
   not meet.

So a group of copies, however large, is sent once; only what its leaders do not join is sent more often, as
often as the cluster has blocks. Equal word sequences are one text throughout.

Texts of fewer than five words are one shingle. Null, empty and blank texts are equal. Repeated rows and null
doc_ids are as in simhash.py.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideloom.functions.cuts import cut
from tideloom.llm.common import binary, bitmap, map_batches, only, spread_join, word_chunks
from tideloom.llm.components import SMALL_GRAPH, component_stars
from tideloom.llm.simhash import fingerprint, keep_documents, linked_pairs, ring_masks

SEGMENTS, SEGMENT = 21, 3
BOXES = SEGMENTS * SEGMENT
DIFFERING = SEGMENTS - 1
_RNG = np.random.default_rng(20)
_FACTORS = _RNG.integers(0, 1 << 63, BOXES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RNG.integers(0, 1 << 63, BOXES, dtype=np.uint64)


def shingles(text: bytes | None, width: int = 5) -> np.ndarray:
    """The distinct XXH64 values of the word shingles, sorted; of the whole text where it is shorter."""
    parts, tail, short = [], [], []
    for words in word_chunks((text or b"").lower()):
        words = tail + words
        short = words
        if len(words) >= width:
            parts.append(np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*[words[i:] for i in range(width)], strict=False))), dtype=np.uint64, count=len(words) - width + 1))
        tail = words[-(width - 1) :] if width > 1 else []
    if not parts:
        return np.array([xxhash.xxh64_intdigest(b" ".join(short))], dtype=np.uint64)
    return np.unique(np.concatenate(parts))


def boxes(found: np.ndarray) -> np.ndarray:
    """The least value of each box's hash."""
    least = np.full(BOXES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), 2048):
        np.minimum(least, (found[at : at + 2048, None] * _FACTORS + _SHIFTS).min(axis=0), out=least)
    return least


def _segment_keys(least: np.ndarray) -> np.ndarray:
    """One key for each segment, of its place and its boxes."""
    key = np.arange(SEGMENTS, dtype=np.uint64)
    for box in least.reshape(SEGMENTS, SEGMENT).T:
        key = (key ^ box) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def sketches(docs: DataFrame, width: int = 5) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, id, size, sign, fp, near): a key of the word sequence, the text's bytes, its SimHash fingerprint, one bit a box, and the segments' keys."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in binary(batch.column(1)):
            data = (text or b"").lower()
            least = boxes(shingles(data, width))
            bits = np.packbits(np.append((least * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(63), 0).astype(np.uint8), bitorder="little").view("<i8")[0]
            rows.append((_text_id(data), len(data), _signed(fingerprint(data)), int(bits), _segment_keys(least).tolist()))
        cols = list(zip(*rows, strict=True)) or [[], [], [], [], []]
        kinds = (*[pa.int64()] * 4, pa.list_(pa.int64()))
        return pa.record_batch([batch.column(0).cast(pa.int64()), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["doc_id", "id", "size", "sign", "fp", "near"])

    return map_batches(only(docs, "doc_id", "text"), make, "doc_id long, id long, size long, sign long, fp long, near array<long>")


def _text_id(text: bytes) -> int:
    """XXH64 (seed 42) of the lower-cased words, one space between them."""
    digest, gap = xxhash.xxh64(seed=42), b""
    for words in word_chunks(text.lower()):
        digest.update(gap + b" ".join(words))
        gap = b" "
    return _signed(digest.intdigest())


def word_id(text: Column) -> Column:
    """The same number as an expression, which needs no Python."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.xxhash64(F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), upper, lower), "[ \\t\\n\\x0B\\f\\r]+", " ")))


def _within(fp: str, hub_fp: str, most: int):
    """The bits' chains from the key's segment stay in budget, and all of them within `most`."""
    masks = ring_masks(SEGMENTS)
    differing = F.col(fp).bitwiseXOR(F.col(hub_fp))
    good = F.bit_count(differing) <= most
    for n in (2, 4, 8, 16):
        mask = F.element_at(F.array(*[F.lit(_signed(masks[i][n - 1])) for i in range(SEGMENTS)]), F.col("at") + 1)
        good &= F.bit_count(differing.bitwiseAND(mask)) <= DIFFERING * n // SEGMENTS
    return good


def candidate_links(texts: DataFrame, most_bits: int = 15) -> DataFrame:
    """texts(id, fp, near) -> (u, v): each text with the least and the greatest id of every key it shares, where the ring's budgets hold."""
    keyed = texts.select("id", "fp", F.posexplode("near").alias("at", "key"))
    ends = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.min_by("fp", "id").alias("a_fp"), F.max("id").alias("z"), F.max_by("fp", "id").alias("z_fp")).where("n > 1").drop("n")
    met = keyed.join(ends, "key")
    hubs = F.array(*[F.when((F.col("id") != F.col(hub)) & _within("fp", f"{hub}_fp", most_bits), F.col(hub)) for hub in ("a", "z")])
    found = met.select("id", F.explode(F.array_compact(hubs)).alias("hub"))
    return found.select(F.least("id", "hub").alias("u"), F.greatest("id", "hub").alias("v")).distinct()


def sign_links(texts: DataFrame) -> DataFrame:
    """texts(id, sign) -> (u, v), whose components are those of the texts at two or fewer differing bits of their SimHash fingerprints."""
    hubs = cut(texts.groupBy("sign").agg(F.min("id").alias("hub")))
    same = spread_join(texts.select("id", "sign"), hubs, "sign").where("id <> hub").select(F.col("hub").alias("u"), F.col("id").alias("v"))
    ends = [hubs.select(F.col("sign").alias(end), F.col("hub").alias(f"{end}_hub")) for end in ("u", "v")]
    near = linked_pairs(hubs.select(F.col("sign").alias("fp"))).join(ends[0], "u").join(ends[1], "v")
    return same.union(near.select(F.least("u_hub", "v_hub").alias("u"), F.greatest("u_hub", "v_hub").alias("v"))).distinct()


def _clusters(edges: DataFrame, one_task: int = 0) -> DataFrame:
    """edges(u, v) -> (id, root) of every text with a link. Each text's least partner is followed first, which leaves few links to the general method."""
    if one_task:
        stars = component_stars(edges, one_task)
        return stars.select(F.col("node").alias("id"), "root").union(stars.select("root", "root").distinct())
    first = component_stars(edges.groupBy("v").agg(F.min("u").alias("u")))
    a, b = first.select(F.col("node").alias("u"), F.col("root").alias("ru")), first.select(F.col("node").alias("v"), F.col("root").alias("rv"))
    between = edges.select("u", "v").join(a, "u", "left").join(b, "v", "left").select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v")).where("u <> v").distinct()
    second = component_stars(between)
    ids = edges.select(F.col("u").alias("id")).union(edges.select("v")).distinct()
    named = ids.join(first.select(F.col("node").alias("id"), F.col("root").alias("r1")), "id", "left").select("id", F.coalesce("r1", "id").alias("r1"))
    return named.join(second.select(F.col("node").alias("r1"), F.col("root").alias("r2")), "r1", "left").select("id", F.coalesce("r2", "r1").alias("root"))


def _alike(shared, n, m, similarity: float):
    """Whether sets of n and m values that share so many are alike enough."""
    return shared >= similarity * (n + m - shared) - 1e-9


def _exact_links(group: pa.Table, similarity: float, width: int, leaders: int = 8) -> pa.Table:
    """Each text of a group with the least text it is linked to over any number of links.

    Texts first meet the first texts of the components found so far, up to `leaders` of them, which joins most
    of a group of copies. Two texts of the largest component need no more; every other text is then compared
    with all, its shared shingles counted through postings. The links are joined here, and one row a text leaves.
    """
    ids = group.column("id").to_pylist()
    order = sorted(range(len(ids)), key=ids.__getitem__)
    sets = [shingles(t, width) for t in binary(group.column("text"))]
    sets = [sets[i] for i in order]
    sizes = np.array([len(s) for s in sets])
    least = list(range(len(order)))

    def root(x: int) -> int:
        while least[x] != x:
            least[x] = least[least[x]]
            x = least[x]
        return x

    def join(a: int, b: int) -> None:
        a, b = root(a), root(b)
        least[max(a, b)] = min(a, b)

    first = []
    for k, mine in enumerate(sets):
        met = [j for j in first if _alike(min(sizes[j], sizes[k]), sizes[j], sizes[k], similarity) and _alike(len(np.intersect1d(sets[j], mine, assume_unique=True)), sizes[j], sizes[k], similarity)]
        for j in met:
            join(j, k)
        if not met and len(first) < leaders:
            first.append(k)
    roots = np.array([root(k) for k in range(len(order))])
    left = np.flatnonzero(roots != np.bincount(roots).argmax())
    if len(left):
        _, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(order), dtype=np.int32), sizes)
        by_shingle = np.argsort(inverse, kind="stable")
        holders, starts = owner[by_shingle], np.searchsorted(inverse[by_shingle], np.arange(inverse.max() + 2))
        for k in left.tolist():
            mine = inverse[ends[k] - sizes[k] : ends[k]]
            shared = np.zeros(len(order), dtype=np.int64)
            for at in range(0, len(mine), 256):
                shared += np.bincount(np.concatenate([holders[starts[s] : starts[s + 1]] for s in mine[at : at + 256]]), minlength=len(order))
            for j in np.flatnonzero(_alike(shared, sizes, sizes[k], similarity)).tolist():
                join(j, k)
    linked = [(ids[order[root(k)]], ids[order[k]]) for k in range(len(order)) if root(k) != k]
    return pa.table([pa.array([u for u, _ in linked], pa.int64()), pa.array([v for _, v in linked], pa.int64())], names=["u", "v"])


def _linked(placed: DataFrame, whole: DataFrame, keys: list[str], similarity: float, width: int) -> DataFrame:
    """placed(id, *keys) -> (u, v): the links within each group of the keys."""
    return placed.join(whole, "id").groupBy(*keys).applyInArrow(lambda g: _exact_links(g, similarity, width), "u long, v long")


def _to_each(count: str):
    """One row for each number below the count."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))


def _unmet(members: DataFrame, links: DataFrame, block_bytes: int) -> DataFrame | None:
    """members(id, root, size, block, blocks) -> (id, root, asked, block) for the texts outside the largest component of
    clusters of several blocks, against every block; None if there are none."""
    several = members.where("blocks > 1")
    part = several.join(links.select(F.col("node").alias("id"), F.col("root").alias("part")), "id", "left").withColumn("part", F.coalesce("part", "id"))
    largest = part.groupBy("root", "part").agg(F.count("*").alias("n")).groupBy("root").agg(F.max_by("part", F.struct("n", "part")).alias("largest"))
    outside = cut(part.join(largest, "root").where("part <> largest").select("id", "root", "size", "blocks"))
    if outside.isEmpty():
        return None
    asked = outside.groupBy("root").agg(F.ceil(F.sum("size") / block_bytes).alias("asked_blocks"))
    asking = outside.join(asked, "root").select("id", "root", F.pmod(F.xxhash64("id", F.lit(1)), F.greatest("asked_blocks", F.lit(1))).alias("asked"), _to_each("blocks").alias("block"))
    met = several.join(asked, "root").withColumn("asked_blocks", F.greatest("asked_blocks", F.lit(1))).select("id", "root", _to_each("asked_blocks").alias("asked"), "block")
    return cut(asking.union(met).distinct())


def link_clusters(texts: DataFrame, edges: DataFrame, whole: DataFrame, similarity: float = 0.8, width: int = 5, block_bytes: int = 2_000_000, meet: Callable[[DataFrame, DataFrame], DataFrame] | None = None, one_task: int = 0) -> DataFrame:
    """texts(id, size), edges(u, v), whole(id, text) -> (node, root): the components of the pairs of `similarity` or more
    within the components of `edges`. whole has each id of edges once; other ids do no harm.

    In clusters of several blocks, texts that one component does not hold meet the other blocks: with their texts, or
    where `meet` is given, by the pairs that meet(members(id, root, block, part), whole) -> (u, v, apart) finds, which
    must hold every pair of two blocks and two parts at the similarity, the likeliest with the least `apart`.
    """
    ends = edges.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    clustered = cut(_clusters(edges, one_task).join(texts.select("id", "size"), "id").join(ends, "id"))
    sizes = clustered.groupBy("root").agg(F.greatest(F.lit(1), F.ceil(F.sum("size") / block_bytes)).alias("blocks"), F.max_by("id", F.struct("links", "id")).alias("most_linked"))
    members = cut(clustered.join(sizes, "root").select("id", "root", "size", "most_linked", "blocks", F.pmod(F.xxhash64("id"), "blocks").alias("block")))
    leaders = sizes.where("blocks > 1").select(F.explode(F.array("root", "most_linked")).alias("id"), "root", _to_each("blocks").alias("block"))
    placed = cut(members.select("id", "root", "block").union(leaders).distinct())
    whole = whole.join(members.select("id"), "id", "left_semi")
    exact = cut(_linked(placed, whole, ["root", "block"], similarity, width))
    linked = component_stars(exact, one_task)
    if meet is not None:
        return _linked_pairs(members, exact, linked, whole, meet, similarity, width, one_task)
    unmet = _unmet(members, linked, block_bytes)
    if unmet is not None:
        linked = component_stars(exact.union(_linked(unmet, whole, ["root", "asked", "block"], similarity, width)), one_task)
    return linked


def _linked_pairs(members: DataFrame, exact: DataFrame, linked: DataFrame, whole: DataFrame, meet: Callable[[DataFrame, DataFrame], DataFrame], similarity: float, width: int, one_task: int) -> DataFrame:
    """linked, with the links across blocks. Of two parts the likeliest pair is compared first; only where it fails are the others."""
    several = members.where("blocks > 1").join(linked.select(F.col("node").alias("id"), F.col("root").alias("part")), "id", "left")
    several = cut(several.select("id", "root", "block", F.coalesce("part", "id").alias("part")))
    if several.isEmpty():
        return linked
    whole = whole.join(several.select("id"), "id", "left_semi")
    parts = several.select("id", "part")
    found = meet(several, whole).join(parts.select(F.col("id").alias("u"), F.col("part").alias("pu")), "u").join(parts.select(F.col("id").alias("v"), F.col("part").alias("pv")), "v")
    left = cut(found.select("u", "v", F.least("pu", "pv").alias("a"), F.greatest("pu", "pv").alias("b"), "apart"))
    best = left.groupBy("a", "b").agg(F.min(F.struct("apart", "u", "v")).alias("m")).select("a", "b", "m.u", "m.v")
    for again in (False, True):
        placed = (left if again else best).select(F.explode(F.array("u", "v")).alias("id"), F.concat_ws("-", "u", "v").alias("pair"))
        exact = cut(exact.union(_linked(placed, whole, ["pair"], similarity, width)))
        linked = component_stars(exact, one_task)
        roots = linked.select(F.col("node").alias("id"), "root")
        of = lambda side: roots.select(F.col("id").alias(side), F.col("root").alias(f"r{side}"))
        rest = left.join(of("u"), "u", "left").join(of("v"), "v", "left").where(F.coalesce("ru", "u") != F.coalesce("rv", "v")).select(*left.columns)
        left = cut(rest.join(best.select("u", "v"), ["u", "v"], "left_anti"))
        if left.isEmpty():
            break
    return linked


def texts_of(docs: DataFrame, ids: DataFrame, text_id: Callable[[bytes], int]) -> DataFrame:
    """docs(doc_id, text), ids(doc_id, id) -> (id, text), one row an id. A bitmap of the doc_ids spares the other texts the exchange."""
    marked = bitmap(ids.where("doc_id is not null").select(F.xxhash64("doc_id").alias("h")))
    mask = 64 * len(marked) - 1

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        cells = [None if i is None else xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), 42) & mask for i in batch.column(0).to_pylist()]
        some = batch.column(1).filter(pa.array([c is None or bool(marked[c >> 6] >> (c & 63) & 1) for c in cells], pa.bool_()))
        return pa.record_batch([pa.array([text_id(t or b"") for t in binary(some)], pa.int64()), some], names=["id", "text"])

    named = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return map_batches(named, make, "id long, text string").join(ids.select("id"), "id", "left_semi").dropDuplicates(["id"])


def near_copies(docs: DataFrame, similarity: float = 0.8, width: int = 5, block_bytes: int = 2_000_000, one_task: int = SMALL_GRAPH) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, id, component_id, root): the text's id, the smallest doc_id reachable over links of
    `similarity` or more, and the group's own id. Rows without a doc_id are left out.

    Texts are told apart by 64 bits of their words' digest and never by doc_id, which may stand for several. Up to
    `one_task` candidate links are joined in one task each time; more go by rounds, with the same result.
    """
    named = docs.where("doc_id is not null")
    drawn = cut(sketches(named, width))
    texts = cut(drawn.groupBy("id").agg(F.min(F.struct("doc_id", "size", "sign", "fp", "near")).alias("s")).select("id", F.col("s.doc_id").alias("doc_id"), "s.size", "s.sign", "s.fp", "s.near"))
    edges = cut(sign_links(texts).union(candidate_links(texts)).distinct())
    small = one_task if edges.count() <= one_task else 0
    asked = texts.select("doc_id", "id").join(edges.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "id", "left_semi")
    linked = link_clusters(texts, edges, texts_of(named, cut(asked), _text_id), similarity, width, block_bytes, one_task=small)
    rooted = texts.select("id", "doc_id").join(linked.withColumnRenamed("node", "id"), "id", "left").select("id", "doc_id", F.coalesce("root", "id").alias("root"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return spread_join(drawn.select("doc_id", "id"), rooted.select("id", "root").join(least, "root"), "id").select("doc_id", "id", "component_id", "root")


def keep_first(docs: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """One document of each group, with its columns: the one of smallest doc_id. Rows without a doc_id stay.

    Of one doc_id with several texts, those of different groups all stay where each is its group's first.
    """
    some = docs.where("doc_id is not null")
    kept = near_copies(some, similarity, width).groupBy("root").agg(F.min(F.struct("doc_id", "id")).alias("first")).select("first.doc_id", F.col("first.id").alias("mark"))
    return keep_documents(docs, kept, word_id(docs["text"]))
