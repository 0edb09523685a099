"""Quality rules by line labelling with a linear-chain conditional random field.

Each line that has a word is described by a few counts in ranges; a two-state chain (content, boilerplate)
scores the line and its neighbour, and Viterbi decoding labels the lines of a whole text. A document is kept
where the base rules pass and at least `least_content` of its words lie in content lines.

The chain is fitted by maximum likelihood on a bounded sample of labelled documents: at most
`rows_per_class` of each quality, those of least hash, with the whole of their texts. Lines of good documents
are content. Lines of bad documents start as boilerplate; after the first fit the lines that the chain itself
reads as content are relabelled and it is fitted again. With no label of either quality there is no evidence
against a line, and all lines are content.

Null text: no words, so the base rules fail. Repeated rows get the same verdict.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideloom.llm.common import binary

_SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\r\x0b\x0c"
_NOT_POINTS = _SPACE + bytes(range(0x80, 0xC0))  # white space and UTF-8 continuation bytes
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
# Words of legal and navigation lines.
_LEGAL = frozenset(b"license licensed licence copyright copyrighted reserved cookie cookies privacy terms subscribe login".split())

WORDS = (1, 2, 4, 8, 16, 32)
SHARES = (0.02, 0.1, 0.3, 0.6)
WIDTH = 1 + (len(WORDS) + 1) + 6 * (len(SHARES) + 1) + 4


def repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more, first occurrences included."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    row = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)
    v = len(ids)
    pair = row[:-2] * v + row[1:-1]
    if v > 2_000_000:
        pair = np.unique(pair, return_inverse=True)[1]
    keys = pair * v + row[2:]
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    often = np.zeros(n - 2, dtype=bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : n - 2 + k] |= often
    return int(covered.sum())


def base_counts(text: bytes | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole UTF-8 text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.split()
    word_chars = len(text.translate(None, _NOT_POINTS))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line.strip():
            dup += line in seen
            seen.add(line)
    return len(words), word_chars, symbols, dup, repeat_words(words)


def _range(value: float, bounds: tuple) -> int:
    k = 0
    for b in bounds:
        k += value > b
    return k


def line_features(text: bytes) -> tuple[list[list[int]], list[int]]:
    """For each line with a word, the places of its features that are set, and its number of words."""
    found, sizes = [], []
    seen: set[bytes] = set()
    for line in text.split(b"\n"):
        words = line.split()
        if not words:
            continue
        n, size = len(words), len(line)
        letters_up = size - len(line.translate(None, _UPPER))
        letters_low = size - len(line.translate(None, _LOWER))
        shares = (
            (size - len(line.translate(None, _SYMBOLS))) / n,
            letters_up / (letters_up + letters_low + 1),
            (size - len(line.translate(None, _DIGITS))) / size,
            line.count(b"!") / n,
            1 - len(set(words)) / n,
            line.count(b"|") / n,
        )
        at = 1
        places = [0, at + _range(n, WORDS)]
        at += len(WORDS) + 1
        for s in shares:
            places.append(at + _range(s, SHARES))
            at += len(SHARES) + 1
        if line in seen:
            places.append(at)
        if not line.rstrip().endswith((b".", b"!", b"?", b":", b'"')):
            places.append(at + 1)
        if not _LEGAL.isdisjoint(line.lower().split()):
            places.append(at + 2)
        if size / n > 20:
            places.append(at + 3)
        seen.add(line)
        found.append(places)
        sizes.append(n)
    return found, sizes


class Chain:
    """Emission weights (WIDTH, 2) and transition weights (2, 2); state 0 is content."""

    def __init__(self, emit: np.ndarray | None = None, step: np.ndarray | None = None):
        self.emit = np.zeros((WIDTH, 2)) if emit is None else emit
        self.step = np.zeros((2, 2)) if step is None else step

    def scores(self, features: list[list[int]]) -> np.ndarray:
        if not features:
            return np.zeros((0, 2))
        lengths = np.fromiter(map(len, features), dtype=np.int64, count=len(features))
        flat = np.fromiter((p for places in features for p in places), dtype=np.int64, count=int(lengths.sum()))
        return np.add.reduceat(self.emit[flat], np.concatenate([[0], np.cumsum(lengths)[:-1]]), axis=0)

    def viterbi(self, scores: np.ndarray) -> list[int]:
        """The best labels; ties go to content."""
        if not len(scores):
            return []
        (cc, cb), (bc, bb) = self.step.tolist()
        rows = scores.tolist()
        c, b = rows[0]
        back = []
        for ec, eb in rows[1:]:
            from_c, from_b = c + cc >= b + bc, c + cb >= b + bb
            back.append((from_c, from_b))
            c, b = (c + cc if from_c else b + bc) + ec, (c + cb if from_b else b + bb) + eb
        label = 0 if c >= b else 1
        labels = [label]
        for from_c, from_b in reversed(back):
            label = 0 if (from_b if label else from_c) else 1
            labels.append(label)
        return labels[::-1]


def train(documents: list[list[list[int]]], labels: list[list[int]], rounds: int = 120, rate: float = 0.15, decay: float = 1e-3) -> Chain:
    """Maximum likelihood by Adam over padded documents, with exact forward-backward marginals."""
    longest = max(map(len, documents))
    n = len(documents)
    x = np.zeros((n, longest, WIDTH), dtype=np.float32)
    mask = np.zeros((n, longest), dtype=bool)
    y = np.zeros((n, longest), dtype=np.int64)
    for i, (lines, own) in enumerate(zip(documents, labels, strict=True)):
        for t, places in enumerate(lines):
            x[i, t, places] = 1
        mask[i, : len(lines)] = True
        y[i, : len(lines)] = own
    gold = np.zeros((n, longest, 2))
    gold[np.arange(n)[:, None], np.arange(longest)[None], y] = 1
    gold *= mask[..., None]
    both = mask[:, 1:] & mask[:, :-1]
    gold_step = np.einsum("nti,ntj->ij", gold[:, :-1] * both[..., None], gold[:, 1:])
    lines = mask.sum()
    flat = x.reshape(-1, WIDTH)
    theta = [np.zeros((WIDTH, 2)), np.zeros((2, 2))]
    m, v = [np.zeros_like(p) for p in theta], [np.zeros_like(p) for p in theta]
    for it in range(1, rounds + 1):
        emit, step = theta
        score = (flat @ emit).reshape(n, longest, 2) * mask[..., None]
        alpha, beta = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        alpha[:, 0] = score[:, 0]
        for t in range(1, longest):
            moved = np.logaddexp(alpha[:, t - 1, :1] + step[0], alpha[:, t - 1, 1:] + step[1]) + score[:, t]
            alpha[:, t] = np.where(mask[:, t, None], moved, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            ahead = beta[:, t + 1] + score[:, t + 1]
            moved = np.logaddexp(ahead[:, :1] + step[:, 0], ahead[:, 1:] + step[:, 1])
            beta[:, t] = np.where(mask[:, t + 1, None], moved, 0)
        log_z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        node = np.exp(alpha + beta - log_z[:, None, None]) * mask[..., None]
        edge = np.exp(alpha[:, :-1, :, None] + step[None, None] + (score[:, 1:] + beta[:, 1:])[:, :, None, :] - log_z[:, None, None, None]) * both[..., None, None]
        grads = [flat.T @ (gold - node).reshape(-1, 2) / lines - decay * emit, (gold_step - edge.sum(axis=(0, 1))) / lines - decay * step]
        for p, g, a, b in zip(theta, grads, m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p += rate * (a / (1 - 0.9**it)) / (np.sqrt(b / (1 - 0.99**it)) + 1e-8)
    return Chain(*theta)


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = 400, chain_lines: int = 40, most_chains: int = 4000) -> Chain:
    """docs(doc_id, text), labels(doc_id, quality) -> the chain, from a bounded sample of labelled rows.

    The whole text of a chosen row is learned from, in chains of at most `chain_lines` lines; of more than
    `most_chains` of them, those that come first in the order of a hash of doc_id and place.
    """
    chosen = (
        labels.select(labels["doc_id"], labels["quality"])
        .where("quality in (0, 1) and doc_id is not null")
        .groupBy("quality", F.pmod(F.xxhash64("doc_id"), F.lit(rows_per_class)).alias("cell"))
        .agg(F.min_by("doc_id", F.xxhash64("doc_id", F.lit(2))).alias("doc_id"))
        .collect()
    )
    quality = {r["doc_id"]: r["quality"] for r in chosen}
    if len(set(quality.values())) < 2:
        return Chain()
    texts = docs.select(docs["doc_id"], docs["text"]).where(F.col("doc_id").isin(list(quality)) & F.col("text").isNotNull()).dropDuplicates(["doc_id"]).toLocalIterator()
    sample: list[tuple[int, object, int, list[list[int]]]] = []
    for r in texts:
        lines = line_features(r["text"].encode())[0]
        sample += [(zlib.crc32(f"{r['doc_id']}:{at}".encode()), r["doc_id"], at, lines[at : at + chain_lines]) for at in range(0, len(lines), chain_lines)]
        if len(sample) > 2 * most_chains:
            sample = sorted(sample, key=lambda c: c[:3])[:most_chains]
    sample = sorted(sorted(sample, key=lambda c: c[:3])[:most_chains], key=lambda c: c[1:3])
    if len({quality[i] for _, i, _, _ in sample}) < 2:
        return Chain()
    documents = [lines for *_, lines in sample]
    own = [[1 - quality[i]] * len(lines) for _, i, _, lines in sample]
    first = train(documents, own)
    again = [row if not row[0] else first.viterbi(first.scores(lines)) for row, lines in zip(own, documents, strict=True)]
    return train(documents, again) if any(map(any, again)) else first


def judge(docs: DataFrame, chain: Chain, least_content: float = 0.5) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share, content_lines, lines)."""

    def run(batches):
        for batch in batches:
            rows = []
            for text in binary(batch.column(1)):
                counts = base_counts(text)
                failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
                features, sizes = line_features(text or b"")
                labels = chain.viterbi(chain.scores(features))
                content = sum(n for n, label in zip(sizes, labels, strict=True) if not label)
                share = content / counts[0] if counts[0] else 0.0
                rows.append((*counts, failed, not failed and share >= least_content, share, labels.count(0), len(labels)))
            cols = list(zip(*rows, strict=True)) or [[] for _ in range(10)]
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] + [pa.int64()] * 2
            yield pa.record_batch([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=_NAMES)

    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    return plain.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double, content_lines long, lines long")


_NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share", "content_lines", "lines"]
