"""Packing documents into sequences by Karmarkar-Karp multiway differencing.

A document's ids are cut into whole windows of `capacity` and one remainder. The remainders of a group of
consecutive documents are partitioned: every remainder starts as a partial partition with one filled window,
and the two partial partitions of largest imbalance are merged again and again, the fullest window of one
with the emptiest of the other, until one partition is left. The windows come out nearly equal. The window
count starts at ceil(ids / capacity); whenever a window exceeds the capacity it rises and the group is
partitioned again.

Nothing is shuffled and no group is larger than `group_pieces`, whatever the keys: a group is a run of rows
of one input split, so packing keeps the order of its input (what a mixing stage laid down) at the grain of
a group, a retried task gives the same sequences, and a repeated or hot doc_id is no different from others.

Null text gives the end id alone. Repeated rows are packed once each. No rows give no rows.
"""

from __future__ import annotations

import functools
import heapq
import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tideloom.llm.common import binary, giving_back, word_chunks

MARK = b"\x01"
_TAIL = b".,;:!?&*#$%|)"
_CACHED_WORD = 64
_CACHE_WORDS = 1_000_000
_KEPT_WORDS = 150_000
_STEP_BYTES = 1_000_000


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + i) for i, b in enumerate(hidden)}


_BYTE_LETTERS = _byte_letters()


def _core(word: bytes) -> tuple[bytes, ...]:
    core = word.rstrip(_TAIL)
    return (core, word[len(core) :]) if core != word and core[-1:].isalnum() else (word,)


class WordEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, by way of their words.

    The vocabulary file drops white space and never merges across it, so a text's ids are those of its
    words; the words of a batch that are new are encoded together. ASCII letters are lowered first, as the
    vocabulary's own normaliser does. A run of ASCII punctuation behind an ASCII letter or digit is always a
    piece of its own there, so a new word's core and tail are looked up apart.

    The vocabulary's special tokens, where a text holds their strings, cut it before anything is normalised;
    what stands between them is encoded on its own.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content.encode(): i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = {content: struct.pack("<I", i) for content, i in special.items()}
        self.cuts = re.compile(b"(" + b"|".join(map(re.escape, sorted(special, key=len, reverse=True))) + b")") if special else None
        self.tokenizer.encode_special_tokens = True  # words hold none of them as such any more
        (self.mark,) = self.tokenizer.encode(MARK.decode(), add_special_tokens=False).ids
        self.known: dict[bytes, bytes] = {}

    def rest(self) -> None:
        """Between tasks only the words met first are kept, which are the frequent ones, and with them the least memory."""
        self.known = dict(islice(self.known.items(), _KEPT_WORDS))

    def _encode(self, words: list[bytes]) -> list[bytes]:
        """The words' ids. Words of Latin letters only, which normaliser and splitter leave as they are, go
        straight to the merges; the others are encoded as one text with a mark between words, and words
        that hold the mark alone."""
        found: dict[bytes, bytes] = {}
        merge = self.tokenizer.model.tokenize
        for w in words:
            if w.isalpha():
                ids = [t.id for t in merge(w.decode("ascii"))]
            elif self._plain(w):
                ids = [t.id for t in merge(w.decode("latin-1").translate(_BYTE_LETTERS))]
            else:
                continue
            found[w] = struct.pack(f"<{len(ids)}I", *ids)
        plain = [w for w in words if w not in found and MARK not in w]
        text = f" {MARK.decode()} ".join([w.decode("utf-8") for w in plain])
        ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        at = np.flatnonzero(ids == self.mark)
        starts, ends, data = [0, *(4 * (at + 1)).tolist()], [*(4 * at).tolist(), 4 * len(ids)], ids.tobytes()
        if plain:
            found |= zip(plain, [data[i:j] for i, j in zip(starts, ends, strict=True)], strict=True)
        for w in words:
            if w not in found:
                found[w] = np.array(self.tokenizer.encode(w.decode("utf-8"), add_special_tokens=False).ids, dtype="<u4").tobytes()
        return [found[w] for w in words]

    @staticmethod
    def _plain(word: bytes) -> bool:
        text = word.decode("utf-8")
        return text.isalpha() and max(text) < "\u0250" and text == text.lower() and unicodedata.is_normalized("NFC", text)

    def texts(self, texts: list[bytes]) -> list[bytes]:
        if self.cuts and any(map(self.cuts.search, texts)):
            split = [self.cuts.split(t) for t in texts]
            between = iter(self._plain_texts([part for parts in split for part in parts[::2]]))
            return [b"".join([self.special[part] if i % 2 else next(between) for i, part in enumerate(parts)]) for parts in split]
        return self._plain_texts(texts)

    def _plain_texts(self, texts: list[bytes]) -> list[bytes]:
        parts = [list(word_chunks(t.lower())) for t in texts]
        look = self.known.get
        found = [[list(map(look, words)) for words in chunks] for chunks in parts]
        open_lists = [(i, k) for i, lists in enumerate(found) for k, ids in enumerate(lists) if None in ids]
        fresh = self._new_words({w for i, k in open_lists for w, ids in zip(parts[i][k], found[i][k], strict=True) if ids is None})
        for i, k in open_lists:
            found[i][k] = [fresh[w] if ids is None else ids for w, ids in zip(parts[i][k], found[i][k], strict=True)]
        return [b"".join([b"".join(ids) for ids in lists]) for lists in found]

    def _new_words(self, new: set[bytes]) -> dict[bytes, bytes]:
        """The ids of words that are not known yet, and of their halves. Short ones are known from now on."""
        cut = {w: halves for w in new if w[-1] in _TAIL and len(halves := _core(w)) == 2}
        order = sorted(new.difference(cut).union(*cut.values()).difference(self.known))
        fresh: dict[bytes, bytes] = {}
        for at in range(0, len(order), 4096):
            some = order[at : at + 4096]
            fresh.update(zip(some, self._encode(some), strict=True))
        for w, (core, tail) in cut.items():
            fresh[w] = (fresh.get(core) or self.known[core]) + (fresh.get(tail) or self.known[tail])
        if len(self.known) + len(fresh) > _CACHE_WORDS:
            self.known = {}
        self.known.update(item for item in fresh.items() if len(item[0]) <= _CACHED_WORD)
        return fresh


@functools.lru_cache(maxsize=1)
def encoder_of(path: str) -> WordEncoder:
    """One encoder a worker, for all its tasks."""
    return WordEncoder(path)


def difference(lengths: list[int], windows: int) -> list[int]:
    """The window of each length, by multiway differencing into `windows` windows."""
    n = len(lengths)
    owner = np.full(n + max(0, n - 1) * windows, -1, dtype=np.int64)
    heap, merges, seq = [], [], 0
    for j, length in enumerate(lengths):
        sums, nodes = np.zeros(windows, dtype=np.int64), np.full(windows, -1, dtype=np.int64)
        sums[0], nodes[0] = length, j
        heap.append((-length if windows > 1 else 0, seq, sums, nodes))
        seq += 1
    heapq.heapify(heap)
    base = n
    while len(heap) > 1:
        _, _, a, a_nodes = heapq.heappop(heap)
        _, _, b, b_nodes = heapq.heappop(heap)
        sums = a + b[::-1]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        merges.append((base, a_nodes[order], b_nodes[::-1][order]))
        heapq.heappush(heap, (int(sums[-1] - sums[0]), seq, sums, base + np.arange(windows)))
        seq, base = seq + 1, base + windows
    if heap:
        last = heap[0][3]
        owner[last[last >= 0]] = np.arange(windows)[last >= 0]
    for start, left, right in reversed(merges):
        held = owner[start : start + windows]
        for side in (left, right):
            real = side >= 0
            owner[side[real]] = held[real]
    return owner[:n].tolist()


def fullest(lengths: list[int], windows: int) -> int:
    """The fullest window that difference() comes to. The same merges, of the filled windows' sums alone, in ascending order."""
    heap = [(-length if windows > 1 else 0, j, np.array([length], dtype=np.int64)) for j, length in enumerate(lengths)]
    heapq.heapify(heap)
    for seq in range(len(lengths), 2 * len(lengths) - 1):
        _, _, a = heapq.heappop(heap)
        _, _, b = heap[0]
        both = max(0, len(a) + len(b) - windows)  # windows filled in either
        sums = np.concatenate((a[:both] + b[:both][::-1], a[both:], b[both:]))
        sums.sort()
        heapq.heapreplace(heap, (int(sums[0] if len(sums) == windows else 0) - int(sums[-1]), seq, sums))
    return int(heap[0][2][-1]) if heap else 0


def windows_for(lengths: list[int], capacity: int) -> list[int]:
    """The window of each length; as few windows as differencing fits into the capacity."""
    if not lengths:
        return []
    if max(lengths) > capacity:
        raise ValueError("a piece is longer than the capacity")
    count = max(1, -(-sum(lengths) // capacity))
    while (over := fullest(lengths, count) - capacity) > 0:
        count = min(len(lengths), count + max(1, count * over // (8 * capacity)))
    return difference(lengths, count)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, group_pieces: int = 1024, keep_ids: bool = False) -> DataFrame:
    """docs(doc_id, text) -> one row a piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), and ids with `keep_ids`.

    sequence_id has the input split in its upper and a running number in its lower 40 bits.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    if keep_ids:
        schema, names = schema + ", ids array<int>", [*names, "ids"]
    end = np.array([end_id], dtype="<u4").tobytes()
    kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path)
        next_sequence = TaskContext.get().partitionId() << 40
        waiting: list[tuple] = []
        out: list[tuple] = []

        def piece(doc_id, ids: bytes, start: int, length: int, total: int) -> tuple:
            part = ids[4 * start : 4 * (start + length)]
            return doc_id, start, length, zlib.crc32(part), total, part if keep_ids else None

        def put(found: tuple, sequence: int, offset: int) -> None:
            row = (*found[:5], sequence, offset)
            out.append((*row, np.frombuffer(found[5], dtype="<i4")) if keep_ids else row)

        def close() -> None:
            nonlocal next_sequence
            placed = windows_for([p[2] for p in waiting], capacity)
            filled: dict[int, int] = {}
            for found, window in zip(waiting, placed, strict=True):
                put(found, next_sequence + window, filled.get(window, 0))
                filled[window] = filled.get(window, 0) + found[2]
            next_sequence += max(placed, default=-1) + 1
            waiting.clear()

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[] for _ in names]
            made = pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
            out.clear()
            return made

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), [t or b"" for t in binary(batch.column(1))]
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= _STEP_BYTES):
                    size, to = size + len(texts[to]), to + 1
                for doc_id, ids in zip(doc_ids[at:to], encoder.texts(texts[at:to]), strict=True):
                    ids += end
                    total = len(ids) // 4
                    whole = total - total % capacity
                    for start in range(0, whole, capacity):
                        put(piece(doc_id, ids, start, capacity, total), next_sequence, 0)
                        next_sequence += 1
                    if total > whole:
                        waiting.append(piece(doc_id, ids, whole, total - whole, total))
                    if len(waiting) >= group_pieces:
                        close()
                    if len(out) >= 8192:
                        yield flush()
                at = to
        close()
        encoder.rest()
        yield flush()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(giving_back(run), schema)
