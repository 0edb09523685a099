"""Audit of how text filters interact when they are applied one after another, in every order.

Five filters fail a document on its own: A few words, B few distinct words, C many capitals, D symbols, and E
an earlier copy. E is an existential self-join: a document fails where another document of the same digest and
the same bytes has a smaller doc_id. The rows that fail E are united with the rows of the other failures, the
bits of each document are put together, and only the counts of the 32 combinations by part go on. What a step
of an order removes depends on the set of filters before it alone, so 80 (set, filter) cells of a part give all
600 rows.

Texts move only where their digest is shared, which a bitmap of bounded size tells each task (digests.py).
The searched side of the self-join is one row a text with its least doc_id, made in each task before the
exchange. A digest that more than a thousandth of all rows have is dealt over as many salts as thousandths; the
sum of salts is below 2,000, so the copies of the searched side are too.

Null texts are empty, null sources the part ''. A row without a doc_id has no smaller one and no label. Rows of
one doc_id count as a row each, and never fail E through each other. Labels of one doc_id count as set if any of
its rows is. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideloom.functions.cuts import cut
from tideloom.llm.common import binary, map_batches, word_chunks
from tideloom.llm.digests import MOST_BITS, shared_bitmap

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_SYMBOLS = b"#$%&*|"


def failures(text: bytes, chars: int) -> int:
    """The bits of the filters A to D that the text fails."""
    words, seen = 0, set()
    for chunk in word_chunks(text):
        words += len(chunk)
        seen.update(chunk)
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    failed = (words < 50, 100 * len(seen) < 65 * words, 100 * capitals > 5 * chars, len(text.translate(None, _SYMBOLS)) < len(text))
    return sum(1 << bit for bit, fails in enumerate(failed) if fails)


def judged(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, source) -> (doc_id, part, digest, bits) of the filters that see one text."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = pc.fill_null(batch.column(2), "")
        raw = binary(texts)
        bits = [failures(t, n) for t, n in zip(raw, pc.utf8_length(texts).to_pylist(), strict=True)]
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(map(xxhash.xxh3_128_digest, raw), pa.binary()), pa.array(bits, pa.int32())], names=["doc_id", "part", "digest", "bits"])

    return map_batches(_rows(docs), make, "doc_id long, part string, digest binary, bits int")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["source"], F.lit("")).alias("part"), docs["text"].alias("text"))


def _shared_texts(docs: DataFrame, digests: DataFrame, most_bits: int) -> DataFrame:
    """(doc_id, part, digest, text) of the rows whose digest may be shared; none whose digest is shared is missing."""
    marked = shared_bitmap(digests, most_bits)
    mask = 64 * len(marked) - 1

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = pc.fill_null(batch.column(2), "")
        keys = [xxhash.xxh3_128_digest(t) for t in binary(texts)]
        cells = [xxhash.xxh64_intdigest(k, 42) & mask for k in keys]
        found = pa.array([bool(marked[c >> 6] >> (c & 63) & 1) for c in cells], pa.bool_())
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), texts], names=["doc_id", "part", "digest", "text"]).filter(found)

    return map_batches(_rows(docs), make, "doc_id long, part string, digest binary, text string")


def later_copies(docs: DataFrame, digests: DataFrame, most_bits: int = MOST_BITS, share: int = 1000) -> DataFrame:
    """(doc_id, part, digest) of every row whose text a smaller doc_id has too. digests(digest) has a row for each of docs."""
    total = digests.count()
    crowds = digests.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") * share > total).select("digest", F.ceil(F.col("n") * share / F.lit(max(1, total))).alias("salts"))
    crowds = F.broadcast(cut(crowds))  # fewer than `share` rows, as each has over that part of all rows
    texts = _shared_texts(docs, digests, most_bits)
    salts = F.coalesce("salts", F.lit(1).cast("long"))
    firsts = texts.groupBy("digest", "text").agg(F.min("doc_id").alias("first")).join(crowds, "digest", "left")
    firsts = firsts.select("digest", "text", "first", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
    asked = texts.join(crowds, "digest", "left").withColumn("salt", F.pmod(F.xxhash64("doc_id"), salts))
    a, b = asked.alias("a"), firsts.alias("b")
    same = (F.col("a.digest") == F.col("b.digest")) & (F.col("a.salt") == F.col("b.salt")) & (F.col("a.text") == F.col("b.text"))
    return a.join(b, same & (F.col("b.first") < F.col("a.doc_id")), "left_semi").select("doc_id", "part", "digest")


def combinations(docs: DataFrame, labels: DataFrame, most_bits: int = MOST_BITS, share: int = 1000) -> DataFrame:
    """(part, bits, n, good, toxic): the rows of each part by the set of filters they fail, and how many of them are labelled."""
    own = cut(judged(docs))
    copies = later_copies(docs, own.select("digest"), most_bits, share)
    failed = own.select("doc_id", "part", "digest", "bits", F.lit(1).alias("n")).union(copies.select("doc_id", "part", "digest", F.lit(COPY), F.lit(0)))
    rows = failed.groupBy("doc_id", "part", "digest").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    said = labels.select(labels["doc_id"].alias("labelled"), labels["quality"].alias("quality"), labels["toxic"].alias("toxic"))
    said = said.groupBy("labelled").agg(*[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c) for c in ("quality", "toxic")])
    at = F.coalesce("doc_id", F.xxhash64("digest")) == F.col("labelled")  # rows without a doc_id spread out and match none
    known = rows.join(said, at & F.col("doc_id").isNotNull(), "left")
    lost = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0)))
    return known.groupBy("part", "bits").agg(F.sum("n").alias("n"), lost("quality").alias("good"), lost("toxic").alias("toxic"))


def _steps() -> list[tuple[str, int, int, int]]:
    """(order, step, its filter's bit, the bits of the filters before it) of every order."""
    found = []
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            found.append(("".join(order), step, bit, before))
            before |= bit
    return found


def audit(docs: DataFrame, labels: DataFrame, most_bits: int = MOST_BITS, share: int = 1000) -> DataFrame:
    """docs(doc_id, text, source), labels(doc_id, quality, toxic) -> a row for each part, order and step, zeros included.

    kept, removed, redundant, unique_fails, good_lost and toxic_lost are counts within the part; shapley is what
    the step's filter removes, summed over all orders.
    """
    steps = docs.sparkSession.createDataFrame(_steps(), "filter_order string, step int, bit int, before int")
    cells = F.array(*[F.struct(F.lit(bit).alias("bit"), F.lit(before).alias("before")) for bit, before in sorted({s[2:] for s in _steps()})])
    some = combinations(docs, labels, most_bits, share).select("*", F.explode(cells).alias("cell")).select("*", "cell.*")

    def over(condition: Column, value: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(value)).otherwise(0))

    fails, earlier = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits").bitwiseAND(F.col("before")) != 0
    removed = fails & ~earlier
    counts = some.groupBy("part", "bit", "before").agg(
        over(~fails & ~earlier).alias("kept"),
        over(removed).alias("removed"),
        over(fails & earlier).alias("redundant"),
        over(F.col("bits") == F.col("bit")).alias("unique_fails"),
        over(removed, "good").alias("good_lost"),
        over(removed, "toxic").alias("toxic_lost"),
    )
    laid = counts.join(F.broadcast(steps), ["bit", "before"])  # 600 rows
    return laid.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", F.sum("removed").over(Window.partitionBy("part", "bit")).alias("shapley"))


AUDIT_SQL = r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
m AS (
  SELECT doc_id, part,
    CASE WHEN len(ws) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 2 ELSE 0 END
    + CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN first < doc_id THEN 16 ELSE 0 END AS bits FROM w),
g AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, bits, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN g USING (doc_id) GROUP BY ALL),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS x(name, bit)),
o AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a JOIN f b ON b.bit <> a.bit JOIN f c ON c.bit NOT IN (a.bit, b.bit) JOIN f d ON d.bit NOT IN (a.bit, b.bit, c.bit)
  JOIN f e ON e.bit NOT IN (a.bit, b.bit, c.bit, d.bit)),
s AS (SELECT filter_order, step, bits[step] AS bit, list_sum(bits[1:step]) - bits[step] AS before FROM o, unnest(range(1, 6)) AS u(step)),
r AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN bits & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN bits & bit <> 0 AND bits & before = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN bits & bit <> 0 AND bits & before <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN bits = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN bits & bit <> 0 AND bits & before = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN bits & bit <> 0 AND bits & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, (SELECT filter_order, step, bit::INTEGER AS bit, before::INTEGER AS before FROM s) GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r"""
