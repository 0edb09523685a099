"""How far the sources of a language differ in their words, by count-level bitmaps.

Each (lang, source) group smooths its counts of the language's kept terms into whole numbers p, one for each
count that occurs. So a pair of groups needs no row a term: for each group and count a bitset of term ids is
stored, the AND of two bitsets has as many ones as there are terms with these two counts (a joint cell), and a
cell adds its size times f. Cells with a zero count come by complement: the level's size less its joint cells,
and what is left of all kept terms. Written out, a pair is

    sum over levels c of g: size * f(p_g(c), p_h(0)), the same for h, (V - terms of g - terms of h) * f(p_g(0), p_h(0)),
    and over joint cells: ones * (f(p_g(c), p_h(d)) - f(p_g(c), p_h(0)) - f(p_g(0), p_h(d)) + f(p_g(0), p_h(0)))

with f(p, q) = (p - q)^2 div (p + q). A bitset is kept in words of 64 ids. Ids follow the terms' counts, so that
the many rare terms share few levels a word, and a word holds at most 64 levels a group. All numbers are whole;
products with counts are decimals of 38 digits before they are divided.

Terms are counted in each task and leave it as one row a (lang, source, term), at most HELD of them at a time, so
a hot source costs no more rows than another. Null text, lang and source are ''. Repeated rows count again;
doc_id is not read. An empty table gives no rows; a source alone in its language has no pairs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideloom.functions.cuts import cut
from tideloom.llm.common import binary, word_chunks

HELD = 1_000_000  # counted (group, term) pairs of a task in memory
_DOCS = 40  # a task's count of a term stands in the low 40 bits, its documents above
_ONE_DOC, _COUNT = 1 << _DOCS, (1 << _DOCS) - 1
BUCKET_TERMS = 65_536  # terms numbered in one window, on average
_FOLD = bytes(32 if c < 65 or 90 < c < 97 or 122 < c < 128 else c + 32 if c <= 90 else c for c in range(256))


def term_counts(docs: DataFrame, held: int = HELD) -> DataFrame:
    """docs(text, lang, source) -> (lang, source, term, count, docs): occurrences, and documents with the term."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("count", pa.int64()), ("docs", pa.int64())])

    def rows(groups: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), both in groups.items():
            n = len(both)
            values = np.fromiter(both.values(), dtype=np.int64, count=n)
            yield pa.record_batch([pa.repeat(pa.scalar(lang), n), pa.repeat(pa.scalar(source), n), pa.array(list(both), pa.binary()).cast(pa.string()), pa.array(values & _COUNT), pa.array(values >> _DOCS)], schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], dict[bytes, int]] = {}
        size = 0
        for batch in batches:
            for text, lang, source in zip(binary(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                both = groups.setdefault((lang, source), {})
                before, mine = len(both), Counter()
                for words in word_chunks(text.translate(_FOLD)):
                    mine.update(words)
                for term, n in mine.items():
                    both[term] = both.get(term, 0) + _ONE_DOC + n
                size += len(both) - before
                if size > held:
                    yield from rows(groups)
                    groups, size = {}, 0
        yield from rows(groups)

    texts = docs.select(*[F.coalesce(docs[c], F.lit("")).alias(c) for c in ("text", "lang", "source")])
    counted = texts.mapInArrow(count, "lang string, source string, term string, count long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def smoothed(count: str | Column, total: str | Column, terms: str | Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 terms))."""
    wide = lambda c: (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")
    above = F.lit(1_000_000_000).cast("decimal(10,0)") * (wide(count) + 2)
    below = wide(total) + 2 * wide(terms)
    return _div(above, below) + 1


def _div(above: Column, below: Column) -> Column:
    """Whole division of numbers of one sign; null where the divisor is zero."""
    return F.call_function("div", above, F.nullif(below, F.lit(0)))


def divergence(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def _kept(counts: DataFrame, least_docs: int) -> DataFrame:
    """(lang, term, total) of the terms in enough documents of the language."""
    return counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("total")).where(F.col("docs") >= least_docs).select("lang", "term", "total")


def level_words(levels: DataFrame, kept: DataFrame, bucket_terms: int) -> DataFrame:
    """levels(lang, source, term, count, p, p0) -> (lang, bucket, word, source, p, p0, bits): 64 term ids a word, one row a level."""
    buckets = max(1, -(-kept.count() // bucket_terms))
    order = Window.partitionBy("lang", "bucket").orderBy(F.desc("total"), "term")
    ids = kept.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets))).withColumn("id", F.row_number().over(order) - 1)
    placed = levels.join(ids.select("lang", "term", "bucket", "id"), ["lang", "term"])
    bit = F.expr("shiftleft(1L, cast(id % 64 as int))")
    return placed.groupBy("lang", "bucket", F.expr("id div 64").alias("word"), "source", "count", "p", "p0").agg(F.bit_or(bit).alias("bits"))


def _joint(words: DataFrame) -> DataFrame:
    """(lang, a, b, value) with a < b: what the joint cells of each pair add."""
    a, b = words.alias("a"), words.alias("b")
    met = a.join(b, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("lang", "bucket", "word")] + [F.col("a.source") < F.col("b.source"), F.col("a.bits").bitwiseAND(F.col("b.bits")) != 0])
    p, p0, q, q0 = F.col("a.p"), F.col("a.p0"), F.col("b.p"), F.col("b.p0")
    ones = F.bit_count(F.col("a.bits").bitwiseAND(F.col("b.bits")))
    gain = divergence(p, q) - divergence(p, q0) - divergence(p0, q) + divergence(p0, q0)
    return met.groupBy(F.col("a.lang").alias("lang"), F.col("a.source").alias("a"), F.col("b.source").alias("b")).agg(F.sum(ones * gain).alias("value"))


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10, bucket_terms: int = BUCKET_TERMS, held: int = HELD) -> DataFrame:
    """docs(text, lang, source) -> (lang, source, part, item, value, rank).

    Part `pair`: every other source of the language with the divergence of the two, all ranks. Part `term`: the
    terms the group has oftener than its language, by their share of the divergence, ranks to `top`.
    """
    counts = cut(term_counts(docs, held))
    kept = cut(_kept(counts, least_docs))
    found = cut(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "count", "total"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_total"))
    sums = found.groupBy("lang", "source").agg(F.sum("count").alias("source_total"), F.count("*").alias("present"))
    groups = docs.select(*[F.coalesce(docs[c], F.lit("")).alias(c) for c in ("lang", "source")]).distinct().join(langs, "lang", "left").join(sums, ["lang", "source"], "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("terms", "lang_total", "source_total", "present")])
    groups = cut(groups.withColumn("p0", smoothed(F.lit(0), "source_total", "terms")))
    known = found.join(groups, ["lang", "source"])

    levels = known.select("lang", "source", "term", "count", smoothed("count", "source_total", "terms").alias("p"), "p0")
    words = cut(level_words(levels, kept, bucket_terms))
    sizes = words.groupBy("lang", "source", "p").agg(F.sum(F.bit_count("bits")).alias("size"))
    joint = _joint(words)
    others = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("present").alias("item_present"))
    apart = F.col("source") != F.col("item")
    half = sizes.join(others, "lang").where(apart).groupBy("lang", "source", "item").agg(F.sum(F.col("size") * divergence(F.col("p"), F.col("q0"))).alias("value"))
    neither = groups.join(others, "lang").where(apart).select("lang", "source", "item", F.coalesce((F.col("terms") - F.col("present") - F.col("item_present")) * divergence(F.col("p0"), F.col("q0")), F.lit(0).cast("long")).alias("value"))
    parts = neither.union(half).union(half.select("lang", "item", "source", "value")).union(joint.select("lang", "a", "b", "value")).union(joint.select("lang", "b", "a", "value"))
    pairs = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    p, q = smoothed("count", "source_total", "terms"), smoothed("total", "lang_total", "terms")
    over = known.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q").select("lang", "source", F.lit("term").alias("part"), "item", divergence(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).union(over.withColumn("rank", rank).where(F.col("rank") <= top))


DIVERGENCE_SQL = r"""WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
t AS (SELECT id, lang, source, unnest(ts) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 10),
v AS (SELECT lang, count(*) AS v, sum(total) AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
c AS (SELECT g.lang, g.source, k.term, k.total, coalesce(n.n, 0) AS n FROM g JOIN k ON k.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
s AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS m FROM c),
p AS (
  SELECT s.lang, source, term, n, CAST(1 + (1000000000::HUGEINT * (n + 2)) // (m + 2 * v)::HUGEINT AS BIGINT) AS p,
    CAST(1 + (1000000000::HUGEINT * (s.total + 2)) // (v.total + 2 * v)::HUGEINT AS BIGINT) AS q FROM s JOIN v ON v.lang = s.lang),
two AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN two ON two.lang = a.lang AND two.source = a.source AND two.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 10"""
