"""The pipeline on the smallest tables, stage by stage, and the registered queries."""

from __future__ import annotations

import re

import __spark_entry__
import corpus_pipeline
from tideloom.llm import langid, pii, similar

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_their_contracts(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{name}")
        source, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs
        if name != "packing":
            assert docs.columns == source.columns
    first = spark.read.parquet(f"{FOLDER}/documents.parquet")
    told = {r.doc_id: r for r in langid.predict(first, langid.fit(first.where(~langid.held_out(first)))).collect()}
    assert {r.doc_id for r in kept["language"].collect()} == {i for i, r in told.items() if not r.rejected}
    groups = {r.doc_id: r.component_id for r in similar.near_copies(kept["language"]).collect()}
    assert {r.doc_id for r in kept["near_copies"].collect()} == set(groups.values())
    for r in kept["personal_data"].collect():
        assert not pii.base_spans(r.text)
        assert r.n_chars == len(r.text) and (re.search(r"\[(EMAIL|IP|CARD|PHONE|NAME)\]", r.text) or r.text == before[r.doc_id].text)
    assert sorted(r.doc_id for r in kept["mixture"].collect()) == sorted(r.doc_id for r in kept["personal_data"].collect())
    pieces = kept["packing"].collect()
    whole = {}
    for r in pieces:
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.length
    assert whole == {r.doc_id: r.doc_tokens for r in pieces} and set(whole) == {r.doc_id for r in kept["mixture"].collect()}


def test_run_equals_the_stages(spark, tmp_path):
    found = corpus_pipeline.run(spark, FOLDER)
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    rows, again = found.collect(), docs.collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in again) and rows
    filled = {}
    for r in rows:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in filled.values():  # gapless from 0, 4096 tokens at most
        pieces.sort()
        assert all(at == sum(n for _, n in pieces[:i]) for i, (at, _) in enumerate(pieces)) and sum(n for _, n in pieces) <= 4096


def test_stages_of_no_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0


def test_registered_queries():
    names = __spark_entry__.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)
