"""Language identification by compression.

Each language has a zstandard raw-content dictionary cut from a sample of its labelled rows. Texts are
folded first: lower case, every run of ASCII characters other than letters one space. A folded text is
compressed whole, in pieces of PIECE bytes, once with each language's dictionary; the language that makes
it smallest is predicted, and the verdict is rejected where the runner-up is nearly as small.

The dictionaries are fitted on at most `rows_per_language` labelled rows each, those of least hash, and hold
at most `dictionary_bytes`; both are parameters of the fit. Prediction covers every row. A text that is null
or has no letter is `und`, score 0 and rejected. Ties go to the alphabetically first language. With no
labelled row there is no language and every text is `und`.
"""

from __future__ import annotations

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideloom.llm.common import giving_back

PIECE = 8192
LEVEL = 5
_LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"
_FOLD = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def fold(text: str) -> bytes:
    return b" " + b" ".join(text.lower().encode().translate(_FOLD).split()) + b" "


def spread(text: bytes, most: int, cuts: int = 8) -> bytes:
    """The text, or `most` bytes of it in pieces evenly spread from its start to its end."""
    if len(text) <= most:
        return text
    size = max(1, most // cuts)
    return b"".join(text[at : at + size] for at in ((len(text) - size) * i // (cuts - 1) for i in range(cuts)))


def fit(labelled: DataFrame, rows_per_language: int = 400, dictionary_bytes: int = 98_304) -> dict[str, bytes]:
    """labelled(doc_id, text, lang) -> each language's dictionary content.

    The first pass ranks doc_ids by hash within a language (a partial top-k on every task); the second reads
    the chosen rows alone. Each chosen row adds an equal share of bytes, in pieces from all over its text, and an
    eighth of the dictionary at most.
    """
    usable = labelled.where("lang is not null and text is not null and doc_id is not null")
    taken = (
        usable.select("doc_id", "lang")
        .groupBy("lang", F.pmod(F.xxhash64("doc_id"), F.lit(rows_per_language)).alias("cell"))
        .agg(F.min_by("doc_id", F.xxhash64("doc_id", F.lit(1))).alias("doc_id"))
        .collect()
    )
    ids = [r["doc_id"] for r in taken]

    def parts(batches):
        for batch in batches:
            folded = [spread(fold(t), dictionary_bytes // 8) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), pa.array(folded, pa.binary())], names=["id", "lang", "part"])

    texts: dict[str, list[bytes]] = {}
    if ids:
        chosen = usable.where(F.col("doc_id").isin(ids)).select(F.col("doc_id").cast("string"), "lang", "text")
        for r in chosen.mapInArrow(giving_back(parts), "id string, lang string, part binary").distinct().orderBy("lang", "id", "part").toLocalIterator():
            texts.setdefault(r["lang"], []).append(bytes(r["part"]))
    return {lang: _content(found, dictionary_bytes) for lang, found in texts.items()}


def _content(texts: list[bytes], most: int) -> bytes:
    """Pieces of all texts, in shares that together fill the dictionary; what short texts leave goes to the longer."""
    share, left, shares = 0, most, sorted(map(len, texts))
    for i, n in enumerate(shares):
        share = left // (len(shares) - i)
        if n >= share:
            break
        left -= n
    return b"".join(spread(t, share) for t in texts)[:most]


def sizes(text: bytes, coders: list[zstandard.ZstdCompressor]) -> list[int]:
    """Compressed bytes of the whole text with each dictionary."""
    pieces = [text[i : i + PIECE] for i in range(0, len(text), PIECE)]
    return [sum(len(c.compress(p)) for p in pieces) for c in coders]


def predict(docs: DataFrame, dictionaries: dict[str, bytes], least_margin: float = 0.005, keep: list[str] | None = None) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, lang_pred, score, rejected); with `keep`, those columns of docs and the three.

    score is the saving of the best language against the runner-up, scaled so that a saving of a quarter is
    1; with one language only it is 1. rejected: the saving is under `least_margin`, or `und`.
    """
    langs = sorted(dictionaries)

    def make(batches):
        coders = [zstandard.ZstdCompressor(level=LEVEL, dict_data=_prepared(dictionaries[x]), write_content_size=False, write_checksum=False, write_dict_id=False) for x in langs]
        for batch in batches:
            labels, scores, out = [], [], []
            for text in batch.column(0).to_pylist():
                if text is None or not coders or not _LETTER.search(text):
                    labels.append(UNKNOWN), scores.append(0.0), out.append(True)
                    continue
                found = sizes(fold(text), coders)
                best = min(range(len(found)), key=found.__getitem__)
                second = min((n for i, n in enumerate(found) if i != best), default=None)
                saving = 0.25 if second is None else 1 - found[best] / second
                labels.append(langs[best]), scores.append(min(1.0, 4 * saving)), out.append(saving < least_margin)
            made = [pa.array(labels, pa.string()), pa.array(scores, pa.float64()), pa.array(out, pa.bool_())]
            fields = [f.with_name(f"c{i}") for i, f in enumerate(list(batch.schema)[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made], schema=pa.schema([*fields, ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())]))

    carried = [docs["doc_id"].cast("long").alias("doc_id")] if keep is None else [docs[c] for c in keep]
    plain = docs.select(docs["text"].alias("__text"), *carried)
    fields = [T.StructField(f"c{i}", f.dataType, True) for i, f in enumerate(plain.schema.fields[1:])]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    found = plain.mapInArrow(giving_back(make), schema)
    return found.toDF(*plain.columns[1:], "lang_pred", "score", "rejected")


def _prepared(content: bytes) -> zstandard.ZstdCompressionDict:
    made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    made.precompute_compress(level=LEVEL)
    return made


def held_out(docs: DataFrame):
    """Rows never learned from: crc32 of the doc_id as text, modulo 3, is 1."""
    return F.coalesce(F.pmod(F.crc32(docs["doc_id"].cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
