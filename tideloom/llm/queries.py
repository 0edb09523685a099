"""Registered queries of the text operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideloom.llm import digests, divergence, extraction, interaction, langid, lm, mixing, packing, parity, pii, quality, sharding, simhash
from tideloom.llm.common import table

SHARD_BYTES = 256 * 1024


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null text: fingerprint zero. doc_id, fingerprint, component_id."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16("fp").alias("fingerprint"), "component_id")


def op2_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document and the line labeller's verdict. Null and blank texts have no words and fail the base; repeated rows are judged alike."""
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from rows that are not held out; predicts from the text alone."""
    docs = table(spark, sf_dir, "documents")
    fitted = langid.fit(docs.where(~langid.held_out(docs)))
    found = langid.predict(docs, fitted)
    return found.select("doc_id", langid.held_out(found).alias("held_out"), "lang_pred", "score", "rejected")


def op4_exact_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null text counts as empty; the last document's next is the first."""
    return digests.fingerprint_edits(table(spark, sf_dir, "documents"))


def op5_lstm_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; null html gives the empty text."""
    return extraction.extract(table(spark, sf_dir, "pages"), extraction.fit())


def op6_kk_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null text: the end id alone. doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null text is empty. n_* and base_sha256 are of the base spans; spans holds the added ones too."""
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs))


def op8_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigram scores of every document against the counts of all; sums are rounded to six places."""
    found = lm.score(table(spark, sf_dir, "documents"))
    return found.withColumn("log_prob", F.round("log_prob", 6)).withColumn("score", F.round("score", 6))


def op9_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in a mixture that weighs sources by the square root of their blocks. A null source is one of its own; repeated rows and null doc_ids take places of their own."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs)


def op10_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shard; shards hold SHARD_BYTES of text at most. Null text has no bytes; repeated rows share a hash and so a shard."""
    found = sharding.shard(table(spark, sf_dir, "documents"), SHARD_BYTES)
    return found.select("doc_id", "n_bytes", F.lower(F.lpad(F.hex("hash"), 16, "0")).alias("hash"), "shard_id", "depth", "shard_bytes", "shard_docs")


def op11_parity_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of links at a five-word similarity of 0.8 or more. Texts without words are linked with nothing; repeated rows are copies."""
    return parity.join(table(spark, sf_dir, "documents"))


def op12_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in all 120 orders, by part. Null text is empty and a null source the part ''; repeated rows count a row each."""
    return interaction.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sources of a language and the terms that set a source apart. Null text, lang and source are ''."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_crf_quality, op3_langid, op4_exact_digest, op5_lstm_extraction, op6_kk_packing, op7_weak_pii, op8_stupid_backoff, op9_pfair_mix, op10_extendible_shards, op11_parity_jaccard, op12_filter_interaction, op13_source_divergence)}


_BACKOFF_SQL = r"""WITH l AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM l),
t AS (SELECT doc_id, ws[i] AS a, CASE WHEN i > 1 THEN ws[i - 1] END AS b, CASE WHEN i > 2 THEN ws[i - 2] END AS c FROM p),
n AS (SELECT count(*) AS n FROM t),
c1 AS (SELECT a, count(*) AS n1 FROM t GROUP BY a),
c2 AS (SELECT b, a, count(*) AS n2 FROM t WHERE b IS NOT NULL GROUP BY b, a),
c3 AS (SELECT c, b, a, count(*) AS n3 FROM t WHERE c IS NOT NULL GROUP BY c, b, a),
j AS (
  SELECT t.doc_id, CASE WHEN n3 >= 2 THEN 3 WHEN n2 >= 2 THEN 2 ELSE 1 END AS k, CASE WHEN t.c IS NOT NULL THEN 3 WHEN t.b IS NOT NULL THEN 2 ELSE 1 END AS most,
    CASE WHEN n3 >= 2 THEN ln(n3) - ln(h.m) WHEN n2 >= 2 THEN ln(n2) - ln(g.m) ELSE ln(n1) - ln(n.n) END AS s
  FROM t CROSS JOIN n JOIN c1 ON c1.a = t.a LEFT JOIN c2 ON c2.b = t.b AND c2.a = t.a LEFT JOIN c3 ON c3.c = t.c AND c3.b = t.b AND c3.a = t.a
  LEFT JOIN (SELECT a, n1 AS m FROM c1) g ON g.a = t.b LEFT JOIN (SELECT b, a, n2 AS m FROM c2) h ON h.b = t.c AND h.a = t.b),
d AS (SELECT doc_id, count(*) AS n_words, sum(s + (most - k) * ln(0.4::DOUBLE)) AS lp, count(*) FILTER (k = 1) AS n_order1, count(*) FILTER (k = 2) AS n_order2, count(*) FILTER (k = 3) AS n_order3 FROM j GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, round(coalesce(lp, 0), 6) AS log_prob, round(lp / n_words, 6) AS score,
  coalesce(n_order1, 0) AS n_order1, coalesce(n_order2, 0) AS n_order2, coalesce(n_order3, 0) AS n_order3 FROM l LEFT JOIN d USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """Other queries hold steps that SQL has no function for; tests hold them against brute force."""
    return {"op8_stupid_backoff": _BACKOFF_SQL, "op12_filter_interaction": interaction.AUDIT_SQL, "op13_source_divergence": divergence.DIVERGENCE_SQL}
