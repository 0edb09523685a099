"""Personal data by weak supervision.

Base rules find e-mail addresses, IP addresses, card and phone numbers; their spans always stand. Further
candidates (masked addresses, numbers in national form, titled or listed names) get a vote, or none, from
three labelers: one of shapes, one of word lists, one of the words around. Expectation-maximisation over the
counts of all documents' vote patterns estimates how each labeler votes on real and on false spans (base
spans are known to be real), and a logistic classifier of votes and shape is trained on the resulting
probabilities; it decides about every candidate.

Every feature is discrete, so what EM and training need of the corpus is the count of each feature
combination: at most KINDS x 27 votes x 15 shapes rows, from all documents, whatever their number.

Spans are code points, end exclusive. Null text is empty. Equal texts have equal spans.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "name")
BASE_KINDS = 4
Span = tuple[int, int, int]  # kind, start, end

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A start inside a run of digits cannot match where the run's first digit does not, so it is not tried.
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

_MASKED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\s?(?:\[at\]|\(at\)|\{at\}|\sat\s)\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\[dot\]|\(dot\)|\{dot\}|\sdot\s|\.)\s?[A-Za-z0-9-]{2,63}){1,4}")
_NUMBER = re.compile(r"(?<![\w+.,$€£/-])\(?[0-9][0-9().\x20-]{5,20}[0-9](?![\w%€/])")
_NAME = re.compile(r"\b(?:(Mr|Mrs|Ms|Dr|Prof)\.?\x20)?[A-Z][a-z]{1,20}\x20[A-Z][a-z]{1,20}\b|\b(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20[A-Z][a-z]{1,20}\b")
_NATIONAL = re.compile(r"\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}|0[0-9]{2,4}[ /-][0-9]{5,8}")

# Given names, top-level domains, words before personal data and words before other numbers.
_GIVEN = frozenset("James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Anna Peter Maria Hans Sabine Klaus Pierre Jean Sophie Carlos Juan Carmen Lucia Miguel".split())
_DOMAINS = frozenset("com org net edu gov info io de fr es uk eu".split())
_CUES = frozenset("call phone tel telephone telefon mobile cell fax contact email mail write reach dial card visa mastercard name dear patient customer signed".split())
_OTHER = frozenset("order invoice isbn issn version page total item sku serial tracking part article section chapter room no nr number token id".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """A match needs all local characters up to an @ (or back to the match before), so each @ is looked at once."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, (end := found.end())
        at = text.find("@", max(end, at + 1))


def base_spans(text: str) -> list[Span]:
    """Spans of the base rules by kind, then start."""
    found = [(0, a, b) for a, b in emails(text)]
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            found.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            found.append((3, *m.span()))
    return found


def candidates(text: str, base: list[Span]) -> list[Span]:
    """Further spans that may be personal data, none overlapping a base span."""
    found: list[Span] = []
    if "at]" in text or "at)" in text or "at}" in text or (" at " in text and (" dot " in text or "." in text)):
        found += [(0, *m.span()) for m in _MASKED.finditer(text) if not m.group().isalpha() and _looks_masked(m.group())]
    if _DIGIT.search(text):
        for m in _NUMBER.finditer(text):
            n = sum(c.isdigit() for c in m.group())
            if 7 <= n <= 15 and n < m.end() - m.start():
                found.append((3, *m.span()))
            elif 13 <= n <= 19:
                found.append((2, *m.span()))
    found += [(4, *m.span()) for m in _NAME.finditer(text) if m.group(1) or m.group().split(" ")[0] in _GIVEN or m.group().split(" ")[0].rstrip(".") in ("Mr", "Mrs", "Ms", "Dr", "Prof")]
    if not base or not found:
        return sorted(found)
    taken = sorted((a, b) for _, a, b in base)
    starts = np.array([a for a, _ in taken])
    ends = np.maximum.accumulate(np.array([b for _, b in taken]))
    keep = []
    for s in sorted(found):
        i = int(np.searchsorted(starts, s[2])) - 1
        if i < 0 or ends[i] <= s[1]:
            keep.append(s)
    return keep


def _looks_masked(span: str) -> bool:
    return any(x in span for x in ("[at]", "(at)", "{at}", "[dot]", "(dot)", "{dot}", " dot "))


def votes(text: str, span: Span) -> tuple[int, int, int]:
    """Of the shape, list and context labelers: 1 real, 0 false, 2 no vote."""
    kind, a, b = span
    value = text[a:b]
    before = [w.strip(".,:;()#").lower() for w in text[max(0, a - 40) : a].split()[-4:]]
    context = 1 if not _CUES.isdisjoint(before) else 0 if not _OTHER.isdisjoint(before) else 2
    if kind == 0:
        ending = re.split(r"[^A-Za-z0-9]+", value)[-1].lower()
        return 1 if "@" in value or _looks_masked(value) else 0, 1 if ending in _DOMAINS else 0, context
    if kind == 1:
        return 1, 0 if value.startswith(("0.", "255.")) else 2, context
    if kind == 2:
        digits = "".join(c for c in value if c.isdigit())
        return 1 if luhn(digits) else 0, 1 if digits[0] in "3456" else 0, context
    if kind == 3:
        first = re.match(r"\D*(\d+)", value).group(1)
        year = len(first) == 4 and first[:2] in ("19", "20")
        return 1 if value[0] == "+" or _NATIONAL.fullmatch(value) else 0, 0 if year else 2, context
    titled = value.split(" ")[0].rstrip(".") in ("Mr", "Mrs", "Ms", "Dr", "Prof")
    return 1 if titled else 2, 1 if not _GIVEN.isdisjoint(value.split(" ")) else 2, context


def features(text: str, span: Span) -> tuple[int, ...]:
    """(kind, three votes, range of length, separators)."""
    value = text[span[1] : span[2]]
    parts = len(re.findall(r"[^A-Za-z0-9]+", value))
    return (span[0], *votes(text, span), min(4, len(value) // 6), min(2, parts // 2))


class Model:
    """Labelers' reliabilities and the span classifier."""

    def __init__(self, weights: np.ndarray, reliability: np.ndarray, prior: float):
        self.weights, self.reliability, self.prior = weights, reliability, prior

    def probability(self, found: tuple[int, ...]) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(_encode(found) @ self.weights)))))


def _encode(found: tuple[int, ...]) -> np.ndarray:
    x = np.zeros(1 + len(KINDS) + 9 + 5 + 3)
    x[0] = 1
    x[1 + found[0]] = 1
    for i in range(3):
        x[1 + len(KINDS) + 3 * i + found[1 + i]] = 1
    x[1 + len(KINDS) + 9 + found[4]] = 1
    x[1 + len(KINDS) + 14 + found[5]] = 1
    return x


def estimate(counts: dict[tuple[bool, tuple[int, ...]], int], rounds: int = 50) -> Model | None:
    """counts of (base?, features) -> the model; None without any candidate beyond the base spans."""
    rows = sorted(counts)
    if not any(not base for base, _ in rows):
        return None
    n = np.array([counts[r] for r in rows], dtype=float)
    known = np.array([base for base, _ in rows])
    vote = np.array([f[1:4] for _, f in rows])
    share = np.array([(v == 1).sum() - (v == 0).sum() for v in vote])
    real = np.where(known, 1.0, np.clip(0.5 + 0.3 * share - 0.1, 0.05, 0.95))
    table = np.zeros((3, 2, 3))
    prior = 0.5
    for _ in range(rounds):
        free = ~known
        prior = float(np.clip((real * n)[free].sum() / n[free].sum(), 0.02, 0.98))
        for i in range(3):
            for v in range(3):
                at = vote[:, i] == v
                table[i, 1, v] = (real * n)[at].sum() + 1
                table[i, 0, v] = ((1 - real) * n)[at].sum() + 1
            # A labeler is taken to be better than chance: a false span starts from the opposite vote.
            table[i, 1, 1] += 1
            table[i, 0, 0] += 1
            table[i] /= table[i].sum(axis=1, keepdims=True)
        odds = math.log(prior / (1 - prior)) + sum(np.log(table[i, 1, vote[:, i]]) - np.log(table[i, 0, vote[:, i]]) for i in range(3))
        real = np.where(known, 1.0, 1 / (1 + np.exp(-np.clip(odds, -30, 30))))
    x = np.array([_encode(f) for _, f in rows])
    w = np.zeros(x.shape[1])
    weight = np.sqrt(n) / np.sqrt(n).sum()
    for _ in range(40):  # Newton steps of ridge-penalised logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (real - p)) - 1e-3 * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        w += np.linalg.solve(curve, gradient)
    return Model(w, table, prior)


def fit(docs: DataFrame) -> Model | None:
    """docs(text) -> the model, from the feature counts of all documents."""

    def count(batches):
        for batch in batches:
            found: Counter = Counter()
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                base = base_spans(text)
                for s in base:
                    found[(True, features(text, s))] += 1
                for s in candidates(text, base):
                    found[(False, features(text, s))] += 1
            keys = list(found)
            yield pa.record_batch([pa.array([b for b, _ in keys], pa.bool_()), pa.array([list(f) for _, f in keys], pa.list_(pa.int32())), pa.array([found[k] for k in keys], pa.int64())], names=["base", "found", "n"])

    sums = docs.select(docs["text"]).mapInArrow(count, "base boolean, found array<int>, n long").groupBy("base", "found").agg(F.sum("n").alias("n"))
    return estimate({(r["base"], tuple(r["found"])): r["n"] for r in sums.collect()})


def spans_of(text: str | None, model: Model | None, least: float = 0.9) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by kind, then start."""
    text = text or ""
    base = base_spans(text)
    more = [s for s in candidates(text, base) if model and model.probability(features(text, s)) >= least]
    return base, sorted(base + more)


def write_spans(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, model: Model | None, least: float = 0.9) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added); n_* count base spans."""
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, every = spans_of(text, model, least)
                kinds = Counter(k for k, _, _ in base)
                rows.append((*[kinds[k] for k in range(BASE_KINDS)], hashlib.sha256(write_spans(base).encode()).hexdigest(), write_spans(every), len(every) - len(base)))
            cols = list(zip(*rows, strict=True)) or [[] for _ in range(7)]
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.record_batch([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, types, strict=True)]], names=names)

    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    return plain.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def mask(text: str, spans: list[Span]) -> str:
    """The text with each span as [KIND]; of overlapping spans the first names the whole stretch."""
    out, at, held = [], 0, None
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if held and a < held[2]:
            held = (held[0], held[1], max(held[2], b))
            continue
        if held:
            out += [text[at : held[1]], f"[{KINDS[held[0]].upper()}]"]
            at = held[2]
        held = (kind, a, b)
    if held:
        out += [text[at : held[1]], f"[{KINDS[held[0]].upper()}]"]
        at = held[2]
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: Model | None, least: float = 0.9) -> DataFrame:
    """docs with every span of text masked and, where there is one, n_chars to match; other columns as they were."""
    at = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for batch in batches:
            texts = [t if t is None else mask(t, spans_of(t, model, least)[1]) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if size is not None:
                columns[size] = pa.array([n if t is None else len(t) for t, n in zip(texts, columns[size].to_pylist(), strict=True)], batch.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
