"""From raw documents to packed training sequences.

Each stage is a function of (spark, docs, sf_dir); run() writes what a stage returns as Parquet in the shared
folder and gives the next stage the table it rereads. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideloom.functions.cuts import shared_folder
from tideloom.llm import langid, mixing, packing, pii, similar

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: No SQL can express the compression, expectation-maximisation and tokenizer stages; tests hold them against brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told by a clear margin, with lang as predicted. `und` and narrow verdicts go; repeated rows share a fate."""
    known = langid.predict(docs, langid.fit(docs.where(~langid.held_out(docs))), keep=docs.columns)
    return known.where("not rejected").withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more of five-word shingles: the one of smallest doc_id.

    Texts meet by SimHash fingerprints through the pigeonring, and by min-wise keys where sign bits reach too short; shingle sets decide. Null, empty and blank texts are one group. Of repeated rows one stays; rows without a doc_id all stay.
    """
    return similar.keep_first(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data in text as [KIND], n_chars to match. Null texts stay null; repeated rows are masked alike."""
    return pii.redact(docs, pii.fit(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture. A null source is a source of its own; repeated rows and null doc_ids keep their rows."""
    return mixing.in_order(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece of a sequence, groups of documents in the order of the mixture. A null text is the end id alone; repeated rows are packed once each."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("personal_data", mask_personal_data),
    ("mixture", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
