"""The text operators against brute force, round trips and held-out accuracy, with odd rows of every kind."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tideloom.llm import components, digests, extraction, htmlblocks, langid, lm, mixing, packing, pii, quality, queries, sharding, similar, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, cell long, key long, rank int, bucket int"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_texts():
    rng = random.Random(4)
    base = words(rng, 120)
    return [base, base, base.upper(), base + " tail", words(rng, 90), None, "", " \n\t ", "a", "a b", "a b c", "x" * 5000, words(rng, 30_000, 3000), "é   ü\x1c\x85 ǅ", "1 2 3 " * 400]


@pytest.fixture(scope="module")
def docs(spark):
    """Rows with nulls, blanks, copies, repeats and extra columns of clashing names."""
    rows = [(i, t, "en", f"s{i % 3}", 0, "h", 1, 2, 3, 4) for i, t in enumerate(odd_texts())]
    rows += [rows[0], (None, "no id at all here", None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


# --- op1


def slow_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def slow_components(prints):
    label = {p: p for p in prints}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(label, 2):
        if (a ^ b).bit_count() <= 2:
            label[root(a)] = root(b)
    return {p: root(p) for p in label}


def test_fingerprints_equal_brute_force():
    for text in odd_texts():
        assert simhash.fingerprint(None if text is None else text.encode()) == slow_fingerprint(text)


def test_spark_hash_is_the_same_xxh64(spark):
    assert spark.sql("SELECT xxhash64('a b c')").first()[0] & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("bucket_pairs", [64, 2])
def test_links_equal_all_pairs(spark, bucket_pairs):
    rng = random.Random(bucket_pairs)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in list(prints)[:20]:
        for _ in range(6):
            p ^= 1 << rng.randrange(64)
            prints.add(p)
    frame = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    from tideloom.llm.components import component_stars

    stars = {r.node: r.root for r in component_stars(simhash.linked_pairs(frame, bucket_pairs=bucket_pairs)).collect()}
    expected = slow_components(prints)
    groups: dict = {}
    for p in prints:
        groups.setdefault(expected[p], set()).add(simhash._signed(p))
    for members in groups.values():
        assert {stars.get(m, m) for m in members} == {min(members)}


def test_ring_filter_keeps_every_close_pair():
    rng = random.Random(1)
    masks = simhash.ring_masks()
    assert all(sum(m[0] for m in masks) == (1 << 64) - 1 for _ in [0])
    for _ in range(3000):
        x = 0
        for _ in range(rng.randrange(3)):
            x ^= 1 << rng.randrange(64)
        assert any(all((x & masks[i][n - 1]).bit_count() <= 2 * n // 7 for n in range(1, 8)) for i in range(7))


def test_near_duplicates_of_odd_rows(docs):
    found = {r.doc_id: r for r in simhash.near_duplicates(docs).collect() if r.doc_id is not None}
    assert found[0].component_id == found[1].component_id == found[2].component_id == 0
    assert found[5].fp == found[6].fp == found[7].fp == 0 and found[5].component_id == 5
    kept = [r.doc_id for r in simhash.keep_first(docs).collect()]
    assert kept.count(0) == 1 and 1 not in kept and 4 in kept and None in kept


def test_near_duplicates_of_no_rows(empty):
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_first(empty).count() == 0


# --- near copies of the pipeline


def slow_copies(rows, similarity=0.8):
    """Components over all pairs of different word sequences whose five-word shingle sets are alike enough."""
    sets, label = {}, {}
    for i, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets[i], label[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or frozenset([tuple(w)]), i

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            label[y] = x
    return {i: root(i) for i in sets}


def edited_texts(seed, groups=12, copies=8):
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        base = words(rng, rng.randrange(80, 400), 5000).split()
        out.append(" ".join(base))
        for _ in range(copies):
            copy = list(base)
            for _ in range(rng.randrange(1, max(2, len(base) // 35))):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(9999)}"
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize(("groups", "copies"), [(12, 8), (2, 70)])
def test_edited_copies_equal_all_pairs(spark, groups, copies):
    rows = list(enumerate(edited_texts(3, groups, copies)))
    found = {r.doc_id: r.component_id for r in similar.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == slow_copies(rows)


@pytest.mark.parametrize("block_bytes", [3_000, 20_000, 2_000_000])
def test_clusters_of_many_blocks_equal_all_pairs(spark, block_bytes):
    rng, passage = random.Random(8), words(random.Random(9), 150, 5000)
    texts = edited_texts(3, 3, 30) + [passage + " " + words(rng, rng.randrange(20, 60), 5000) for _ in range(40)]
    rows = list(enumerate(texts))
    found = {r.doc_id: r.component_id for r in similar.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=block_bytes).collect()}
    assert found == slow_copies(rows)


def test_small_link_graphs_take_no_rounds(spark, monkeypatch):
    """Three graphs of links, of which one count each is taken; by rounds, which larger graphs take, the components are the same."""
    rng, passage = random.Random(8), words(random.Random(9), 150, 5000)
    texts = edited_texts(3, 3, 30) + [passage + " " + words(rng, rng.randrange(20, 60), 5000) for _ in range(40)]
    rows, counted, signature = list(enumerate(texts)), [], components._signature
    monkeypatch.setattr(components, "_signature", lambda edges: counted.append(1) or signature(edges))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    small = {r.doc_id: r.component_id for r in similar.near_copies(docs, block_bytes=3_000).collect()}
    assert len(counted) == 3
    rounds = {r.doc_id: r.component_id for r in similar.near_copies(docs, block_bytes=3_000, one_task=10).collect()}
    assert len(counted) > 9 and small == rounds == slow_copies(rows)


@pytest.mark.parametrize("share", [0.3, 0.6, 0.85])
def test_pairs_behind_a_hot_passage_are_found(spark, share):
    """Every text holds one passage, so its keys are crowded; pairs at a similarity just over 0.8 must still meet."""
    rng, rows = random.Random(int(100 * share)), []
    for _ in range(150):
        passage = words(random.Random(9), int(200 * share), 5000)
        own = words(rng, 200 - int(200 * share), 5000).split()
        copy = list(own)
        copy[len(copy) // 2] = copy[len(copy) // 3] = "changed"
        rows += [passage + " " + " ".join(own), passage + " " + " ".join(copy)]
    rows = list(enumerate(rows))
    truth = slow_copies(rows)
    found = {r.doc_id: r.component_id for r in similar.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=50_000).collect()}
    assert sum(found[i] == truth[i] for i in truth) >= 0.99 * len(truth) and all(truth[found[i]] == truth[i] for i in truth)


def test_simhash_links_are_candidates_and_sets_decide(spark, monkeypatch):
    """Without the min-wise ring, what is linked at two or fewer sign bits is still found, and no link of too few shared shingles."""
    rng, texts = random.Random(12), []
    for _ in range(25):
        base = words(rng, 600, 5000).split()
        texts += [" ".join(base), " ".join([*base[:-1], "other"]), " ".join(["other", *base[1:]])]
    texts += ["the very same line of words again " * 300 + words(rng, 12, 5000) for _ in range(6)]
    texts += texts[:3]
    rows = list(enumerate(texts))
    prints = [simhash.fingerprint(t.encode()) for t in texts]
    truth = slow_copies(rows)
    near = {(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (prints[i] ^ prints[j]).bit_count() <= 2}
    assert any(truth[i] == truth[j] and texts[i] != texts[j] for i, j in near) and any(truth[i] != truth[j] for i, j in near)
    monkeypatch.setattr(similar, "candidate_links", lambda texts: texts.where("false").select(texts["id"].alias("u"), texts["id"].alias("v")))
    found = {r.doc_id: r.component_id for r in similar.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[i] == found[j] for i, j in near if truth[i] == truth[j]) and all(truth[found[i]] == truth[i] for i in truth)


def test_near_copies_of_odd_and_no_rows(docs, empty):
    found = {r.doc_id: r.component_id for r in similar.near_copies(docs).collect()}
    assert found == slow_copies([(r.doc_id, r.text) for r in docs.where("doc_id is not null").dropDuplicates(["doc_id"]).collect()])
    kept = [r.doc_id for r in similar.keep_first(docs).collect()]
    assert sorted(x for x in kept if x is not None) == sorted(set(found.values())) and kept.count(None) == 1
    assert similar.near_copies(empty).count() == 0 and similar.keep_first(empty).count() == 0


def test_a_worker_gives_its_memory_back():
    import pathlib

    import pyarrow as pa

    from tideloom.llm.common import giving_back

    def held():
        return int(re.search(r"VmRSS:\s+(\d+)", pathlib.Path("/proc/self/status").read_text())[1]) // 1024

    def run(batches):
        for n in batches:
            large = pa.array([bytes(1000)] * n)
            yield pa.record_batch([pa.array([len(large)])], names=["n"])

    before = held()
    assert [b.column(0)[0].as_py() for b in giving_back(run)(iter([300_000, 10]))] == [300_000, 10]
    assert held() < before + 60


# --- op2


def slow_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = list(zip(w, w[1:], w[2:], strict=False))
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_base_counts_equal_brute_force():
    for text in [*odd_texts(), "a b c a b c\n\na b\na b", "#*$%&|<>", "é é é é", "a a a a a"]:
        assert quality.base_counts(None if text is None else text.encode()) == slow_counts(text)


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(0)
    chain = quality.Chain(step=rng.normal(size=(2, 2)))
    for _ in range(30):
        scores = rng.normal(size=(6, 2))
        best = max(itertools.product((0, 1), repeat=6), key=lambda p: sum(scores[i, a] for i, a in enumerate(p)) + sum(chain.step[a, b] for a, b in itertools.pairwise(p)))
        assert chain.viterbi(scores) == list(best)


def test_chain_maximises_the_exact_likelihood():
    """The objective, with the partition function summed over every labelling, falls whichever way a fitted weight is moved."""
    documents, labels = [[[0, 3], [1], [0, 2]], [[1, 2], [0]], [[3], [3, 1], [0], [2]]], [[0, 1, 1], [1, 0], [0, 0, 1, 0]]
    decay, lines = 1e-2, 9

    def objective(emit, step):
        total = 0.0
        for rows, own in zip(documents, labels, strict=True):
            def value(path, rows=rows):
                return sum(emit[p, y] for places, y in zip(rows, path, strict=True) for p in places) + sum(step[a, b] for a, b in itertools.pairwise(path))

            every = [value(path) for path in itertools.product((0, 1), repeat=len(rows))]
            total += value(own) - max(every) - math.log(sum(math.exp(v - max(every)) for v in every))
        return total / lines - decay / 2 * ((emit**2).sum() + (step**2).sum())

    chain = quality.train(documents, labels, rounds=4000, rate=0.02, decay=decay)
    best = objective(chain.emit, chain.step)
    for table, spots in ((0, [(p, y) for p in range(4) for y in (0, 1)]), (1, list(itertools.product((0, 1), repeat=2)))):
        for spot in spots:
            for move in (-0.05, 0.05):
                moved = [chain.emit.copy(), chain.step.copy()]
                moved[table][spot] += move
                assert objective(*moved) < best


def test_chain_learns_to_tell_lines(spark):
    rng = random.Random(3)
    good = [(i, "\n".join(words(rng, 14).capitalize() + "." for _ in range(8))) for i in range(60)]
    bad = [(100 + i, "\n".join(" | ".join(words(rng, 8).split()) + "!!" for _ in range(8))) for i in range(60)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in good + bad], "doc_id long, quality int")
    chain = quality.fit(docs, labels)
    found = {r.doc_id: r for r in quality.judge(docs, chain).collect()}
    assert all(found[i].kept for i, _ in good) and not any(found[i].kept for i, _ in bad)


def test_quality_of_odd_and_no_rows(docs, empty, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    found = quality.judge(docs, quality.fit(docs, labels)).collect()
    assert len(found) == docs.count() and all(r.kept != r.base_failed or not r.kept for r in found)
    assert quality.judge(empty, quality.Chain()).count() == 0


# --- op3


def test_languages_are_told_apart(spark):
    stock = {"en": "the of and to in is that it was for on are with they at this have from".split(), "de": "der die das und ist nicht ein eine zu mit von auf für dem sich auch werden".split(), "fr": "le la les des une est que dans pour qui sur pas avec sont mais nous vous".split()}
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(stock[lang]) for _ in range(40)), lang) for i, lang in enumerate(list(stock) * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fitted = langid.fit(docs.where(~langid.held_out(docs)))
    found = langid.predict(docs, fitted)
    held = found.where(langid.held_out(found)).collect()
    truth = {i: lang for i, _, lang in rows}
    assert len(held) > 30 and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in held)


def test_dictionaries_take_from_whole_texts():
    assert langid.spread(b"abc", 10) == b"abc"
    text = bytes(range(200)) * 10
    found = langid.spread(text, 160)
    assert len(found) == 160 and found[:20] == text[:20] and found[-20:] == text[-20:]
    assert langid.spread(text, 3) and len(langid.spread(text, 3)) <= 8


def test_language_equals_brute_force(spark):
    """Every document's verdict from compressing its whole folded text anew with each dictionary."""
    import zstandard

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    fitted = langid.fit(docs.where(~langid.held_out(docs)))
    found = {r.doc_id: r for r in langid.predict(docs, fitted).collect()}
    held = {r.doc_id: r.h for r in docs.select("doc_id", langid.held_out(docs).alias("h")).collect()}
    right = wrong = 0
    for r in docs.collect():
        assert held[r.doc_id] == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert found[r.doc_id].lang_pred == "und" and found[r.doc_id].score == 0
            continue
        folded = b" " + b" ".join(re.sub("[\x00-\x60\x7b-\x7f]+", " ", r.text.lower()).encode().split()) + b" "
        sizes = {}
        for lang, content in fitted.items():
            coder = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[lang] = sum(len(coder.compress(folded[at : at + langid.PIECE])) for at in range(0, len(folded), langid.PIECE))
        best, second = sorted(sizes, key=lambda lang: (sizes[lang], lang))[:2]
        assert found[r.doc_id].lang_pred == best and found[r.doc_id].score == pytest.approx(min(1.0, 4 * (1 - sizes[best] / sizes[second])))
        if held[r.doc_id] and r.lang and not found[r.doc_id].rejected:
            right, wrong = right + (best == r.lang), wrong + (best != r.lang)
    assert right >= 0.97 * (right + wrong) > 20


def test_language_of_odd_and_no_rows(docs, empty):
    fitted = langid.fit(docs)
    found = {r.doc_id: r for r in langid.predict(docs, fitted).collect()}
    assert found[5].lang_pred == found[6].lang_pred == found[14].lang_pred == "und" and found[5].rejected
    assert found[0].lang_pred == "en"
    assert langid.fit(empty) == {} and langid.predict(docs, {}).where("lang_pred <> 'und'").count() == 0
    assert langid.predict(empty, fitted).count() == 0


# --- op4


def slow_edits(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, xxhash.xxh3_64_intdigest((r[1] or "").encode()) >> 1))
    out = []
    for (doc_id, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        text, following = text or "", following or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), float(digests.canonical(text) == digests.canonical(edited)), float(digests.canonical(text) == digests.canonical(following))))
    return sorted(out, key=str)


@pytest.mark.parametrize("bucket_rows", [8192, 4, 1])
def test_edits_equal_brute_force(docs, bucket_rows):
    found = digests.fingerprint_edits(docs, bucket_rows=bucket_rows).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in found), key=str) == slow_edits([(r.doc_id, r.text) for r in docs.collect()])
    text = {r.doc_id: r.text for r in docs.collect()}
    same = {r.doc_id: r.fingerprint for r in found}
    for a, b in itertools.combinations(same, 2):
        assert (same[a] == same[b]) == (digests.canonical(text[a]) == digests.canonical(text[b]))


@pytest.mark.parametrize("bits", [26, 6])
def test_colliding_digests_are_split_by_bytes(docs, bits):
    weak = lambda form: str(len(form) % 2)
    found = digests.fingerprint_edits(docs, digest=weak, most_bits=bits).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    same = {r.doc_id: r.fingerprint for r in found}
    for a, b in itertools.combinations(same, 2):
        assert (same[a] == same[b]) == (digests.canonical(text[a]) == digests.canonical(text[b]))


def test_canonical_folds():
    assert digests.canonical("ﬁne   CAFÉ\n") == digests.canonical("Fine café") and digests.canonical(None) == b""
    assert digests.canonical("Straße") == digests.canonical("STRASSE")


def test_edits_of_no_and_one_rows(empty, docs):
    assert digests.fingerprint_edits(empty).count() == 0
    row = digests.fingerprint_edits(docs.where("doc_id = 4")).first()
    assert row.near_next == 1.0


# --- op5


@pytest.fixture(scope="module")
def labeller():
    return extraction.fit(300, 5)


def test_made_pages_parse_as_made():
    pages = extraction.training_pages(200, 77)
    assert sum(len(htmlblocks.blocks(p)) == len(y) for p, y in pages) >= 198


def test_labeller_on_unseen_layouts(labeller):
    pages = [(p, y) for p, y in extraction.training_pages(150, 1234) if len(htmlblocks.blocks(p)) == len(y)]
    found = labeller.label([htmlblocks.blocks(p) for p, _ in pages])
    right = sum(int(a == bool(b)) for f, (_, y) in zip(found, pages, strict=True) for a, b in zip(f, y, strict=True))
    assert right / sum(len(y) for _, y in pages) > 0.96


def test_articles_of_the_pages_table(spark, labeller):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    truth = {}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", re.sub(r"<script.*?</script>", "", r.html, flags=re.DOTALL), re.DOTALL).group(1)
        truth[r.page_id] = " ".join(b.text for b in htmlblocks.blocks(inner))
    found = extraction.extract(pages, labeller).collect()
    assert sum(r.text == truth[r.page_id] for r in found) >= 0.96 * len(found) and all(r.n_chars == len(r.text) for r in found)


def test_blocks_of_odd_html():
    assert htmlblocks.blocks(None) == [] and htmlblocks.blocks("<p") == [] and htmlblocks.blocks("<!-- x") == []
    texts = [b.text for b in htmlblocks.blocks("a&amp;b <b>c</b>d<p>e<p>f&#x41;<script>var t='</p>';</script><ul><li>g<li>h</ul><style>i")]
    assert texts == ["a&b cd", "e", "fA", "g", "h"]
    assert [b.text for b in htmlblocks.blocks('<div title="a>b">c\n\t d</div')][0] == "c d"


def test_extraction_of_odd_and_no_rows(spark, labeller):
    pages = spark.createDataFrame([(1, "u", None, "x"), (2, None, "", "y"), (None, "v", "<p>" * 3000, "z"), (1, "u", None, "x")], "page_id long, url string, html string, text string")
    assert [r.text for r in extraction.extract(pages, labeller).collect()] == [""] * 4
    assert extraction.extract(pages.where("false"), labeller).count() == 0


def loss(model, x, mask, y):
    prob = np.clip(model.forward(x, mask)[0].astype(np.float64), 1e-9, 1 - 1e-9)
    return -float(((y * np.log(prob) + (1 - y) * np.log(1 - prob)) * mask).sum() / mask.sum())


def test_gradients_equal_finite_differences():
    rng, model = np.random.default_rng(3), extraction.Labeller(1)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, mask = rng.random((3, 6, extraction.INPUT)), np.array([[1] * 6, [1] * 4 + [0] * 2, [1] + [0] * 5], dtype=bool)
    y = (rng.random((3, 6)) < 0.5).astype(np.float64)
    found = model.gradients(x, mask, y)
    for name, value in model.p.items():
        for at in rng.choice(value.size, min(6, value.size), replace=False):
            spot, step = np.unravel_index(at, value.shape), 1e-4
            kept = value[spot]
            value[spot] = kept + step
            above = loss(model, x, mask, y)
            value[spot] = kept - step
            below = loss(model, x, mask, y)
            value[spot] = kept
            assert found[name][spot] == pytest.approx((above - below) / (2 * step), abs=2e-5)


def test_forward_equals_a_scalar_loop():
    rng, model, size = np.random.default_rng(4), extraction.Labeller(2), extraction.HIDDEN
    x = rng.random((1, 5, extraction.INPUT)).astype(np.float32)
    states = {}
    for d, order in (("f", range(5)), ("b", range(4, -1, -1))):
        h, c = [0.0] * size, [0.0] * size
        for t in order:
            g = [float(model.p[f"c{d}"][j]) + sum(float(x[0, t, a]) * float(model.p[f"w{d}"][a, j]) for a in range(extraction.INPUT)) + sum(h[a] * float(model.p[f"u{d}"][a, j]) for a in range(size)) for j in range(4 * size)]
            gate = [1 / (1 + math.exp(-v)) for v in g[: 3 * size]]
            c = [gate[size + j] * c[j] + gate[j] * math.tanh(g[3 * size + j]) for j in range(size)]
            h = [gate[2 * size + j] * math.tanh(c[j]) for j in range(size)]
            states[d, t] = h
    for t in range(5):
        z = float(model.p["oc"][0]) + sum(float(w) * v for w, v in zip(model.p["o"], states["f", t] + states["b", t], strict=True))
        assert model.forward(x, np.ones((1, 5), bool))[0][0, t] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-5)


@pytest.mark.parametrize(("page", "count"), [("<div>x" * 100_000, 100_000), ("<div>" * 100_000 + "x</p>" * 100_000, 100_000), ("<b>" * 50_000 + "<li>x" * 50_000, 50_000), ("<div><b>" * 50_000 + "</b>x" * 50_000, 1)])
def test_hostile_nesting_takes_linear_time(page, count):
    began = time.perf_counter()
    found = htmlblocks.blocks(page)
    assert len(found) == count and time.perf_counter() - began < 5
    assert extraction.vector(found[-1]).shape == (extraction.INPUT,)


def test_the_whole_path_and_all_words_count():
    def last(page):
        return extraction.vector(htmlblocks.blocks(page)[-1])

    deep = "<div>" * 40
    assert not np.allclose(last(f'<div class="comments">{deep}x'), last(f'<div class="article">{deep}x'))
    wordy = " ".join(f"w{i}" for i in range(9))
    assert not np.allclose(last(f'<div class="{wordy} footer">x'), last(f'<div class="{wordy} story">x'))
    assert not np.allclose(last("<p>" + "a " * 300 + "b"), last("<p>" + "a " * 300 + "c"))


# --- op6


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_words_give_the_ids_of_whole_texts(vocabulary):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary)
    texts = [t or "" for t in odd_texts()] + ["don't I'LL 'S!! a.b x1. É. é. \x01 a\x01b 漢字、かな <|endoftext|> ΑΣ İ ﬁ", "́ x"]
    texts += ["a<|endoftext|>b", "<|startoftext|><|endoftext|>", "e<|endoftext|>\u0301 <|ENDOFTEXT|> <|EndOfText|>x", " <|endoftext|> end <|endoftext|", "don<|startoftext|>'t"]
    encoder = packing.WordEncoder(vocabulary)
    for t, got in zip(texts, encoder.texts([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(4))
def test_differencing_fits_and_loses_nothing(seed):
    rng = random.Random(seed)
    lengths = [rng.randrange(1, 1000) for _ in range(rng.choice((1, 2, 50, 300)))]
    found = packing.windows_for(lengths, 1000)
    sums = Counter()
    for n, w in zip(lengths, found, strict=True):
        sums[w] += n
    assert max(sums.values()) <= 1000 and len(found) == len(lengths)
    assert len(sums) <= max(len(lengths) // 300 + 2, math.ceil(sum(lengths) / 1000) * 1.25 + 1)


def test_differencing_known_case():
    found = packing.difference([8, 7, 6, 5, 4], 2)
    assert sorted(sum(n for n, w in zip([8, 7, 6, 5, 4], found, strict=True) if w == k) for k in (0, 1)) == [14, 16]


def test_pieces_cover_every_id_once(docs, vocabulary):
    import zlib

    found = packing.pack(docs, vocabulary, keep_ids=True).collect()
    encoder = packing.WordEncoder(vocabulary)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    expected = Counter()
    for doc_id, text in texts:
        ids = encoder.texts([(text or "").encode()])[0] + np.array([2], "<u4").tobytes()
        expected[doc_id, len(ids) // 4] += len(ids) // 4
    got, places = Counter(), {}
    for r in found:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        got[r.doc_id, r.doc_tokens] += r.length
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == expected
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(docs.where("false"), vocabulary).count() == 0


def test_windows_are_counted_before_they_are_filled(monkeypatch):
    """Window counts that do not fit are found by sums alone; which piece lies where is followed once."""
    rng, tried, place = random.Random(17), [], packing.difference
    monkeypatch.setattr(packing, "difference", lambda lengths, windows: tried.append(windows) or place(lengths, windows))
    for _ in range(30):
        lengths = [rng.randrange(0, 101) for _ in range(rng.randrange(1, 120))]
        for windows in (1, 2, 7, len(lengths)):
            assert packing.fullest(lengths, windows) == max(np.bincount(place(lengths, windows), weights=lengths, minlength=windows))
        tried.clear()
        assert max(np.bincount(packing.windows_for(lengths, 100), weights=lengths)) <= 100 and len(tried) == 1


def test_an_encoder_keeps_first_words_between_tasks(vocabulary, monkeypatch):
    monkeypatch.setattr(packing, "_KEPT_WORDS", 3)
    encoder, text = packing.encoder_of(vocabulary), b"some words, met again: some others."
    assert packing.encoder_of(vocabulary) is encoder
    before = encoder.texts([text])
    encoder.rest()
    assert len(encoder.known) == 3 and encoder.texts([text]) == before == packing.WordEncoder(vocabulary).texts([text])


# --- op7

BASE = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def slow_spans(text):
    out = []
    for kind, pattern in enumerate(BASE):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == 1 and any(int(p) > 255 for p in m.group().split(".")) or kind == 2 and not (13 <= len(digits) <= 19 and pii.luhn(digits)) or kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(0)
    texts = ["a@b@c.d e.f@g.h.", "1.2.3.4.5.6.7.8", "001.2.3.4 1.2.3.00000256", "+1 (2) 345 67 89 -", "x@y a@b.c..d@e.f-@g.h", "4111 1111-1111 1111 7", "@a.b %@a.b+@c.d"]
    texts += ["".join(rng.choice("a1@.+- 4()x") for _ in range(80)) for _ in range(600)]
    texts += ["".join(rng.choice("0123456789. ") for _ in range(60)) for _ in range(300)]
    for text in texts:
        assert pii.base_spans(text) == slow_spans(text)


def test_long_runs_take_linear_time():
    import time

    began = time.perf_counter()
    pii.base_spans("1" * 300_000 + " " + "a" * 300_000 + "@ " + "+1" + " " * 300_000)
    assert time.perf_counter() - began < 5


def test_reliabilities_and_classifier_equal_brute_force():
    rng = random.Random(12)
    counts = {(rng.random() < 0.3, (rng.randrange(5), rng.randrange(3), rng.randrange(3), rng.randrange(3), rng.randrange(5), rng.randrange(3))): rng.randrange(1, 9) for _ in range(40)}
    model = pii.estimate(counts)
    spans = [row for row, n in sorted(counts.items()) for _ in range(n)]  # one at a time, as if no counts were kept
    real = [1.0 if base else min(0.95, max(0.05, 0.4 + 0.3 * (sum(v == 1 for v in f[1:4]) - sum(v == 0 for v in f[1:4])))) for base, f in spans]
    for _ in range(50):
        free = [r for r, (base, _) in zip(real, spans, strict=True) if not base]
        prior = min(0.98, max(0.02, sum(free) / len(free)))
        table = [[[1.0] * 3 for _ in (0, 1)] for _ in range(3)]
        for i in range(3):
            table[i][1][1] += 1
            table[i][0][0] += 1
            for r, (_, f) in zip(real, spans, strict=True):
                table[i][1][f[1 + i]] += r
                table[i][0][f[1 + i]] += 1 - r
            table[i] = [[x / sum(row) for x in row] for row in table[i]]
        real = [1.0 if base else 1 / (1 + math.exp(-(math.log(prior / (1 - prior)) + sum(math.log(table[i][1][f[1 + i]] / table[i][0][f[1 + i]]) for i in range(3))))) for base, f in spans]
    assert model.prior == pytest.approx(prior) and np.allclose(model.reliability, table)

    truth = {row: r for row, r in zip(spans, real, strict=True)}
    weight = {row: math.sqrt(n) for row, n in counts.items()}

    def objective(w):
        found = 0.0
        for (base, f), n in weight.items():
            z = float(pii._encode(f) @ w)
            found += n / sum(weight.values()) * (truth[base, f] * z - math.log1p(math.exp(z)))
        return found - 1e-3 / 2 * float(w @ w)

    best = objective(model.weights)
    for at in range(len(model.weights)):
        for move in (-0.05, 0.05):
            moved = model.weights.copy()
            moved[at] += move
            assert objective(moved) < best


def test_model_adds_spans_and_keeps_the_base(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        body = words(rng, 20)
        rows.append((i, f"{body} call me at (555) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)} or mail u{i}@site.org {body}" if i % 2 else f"{body} order 2023-11-12 {rng.randrange(100000, 999999)} page {body}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.fit(docs)
    found = {r.doc_id: r for r in pii.find(docs, model).collect()}
    added = sum(found[i].n_added for i in range(1, 300, 2))
    assert added >= 140 and sum(found[i].n_added for i in range(0, 300, 2)) == 0
    assert all(found[i].n_email == 1 and found[i].base_sha256 == hashlib.sha256(pii.write_spans(slow_spans(rows[i][1])).encode()).hexdigest() for i in range(1, 300, 2))
    masked = {r.doc_id: r.text for r in pii.redact(docs, model).collect()}
    assert "[EMAIL]" in masked[1] and "[PHONE]" in masked[1] and masked[0] == rows[0][1]


def test_pii_of_odd_and_no_rows(docs, empty):
    found = pii.find(docs, pii.fit(docs)).collect()
    assert len(found) == docs.count() and all(r.spans == "" for r in found if r.doc_id in (5, 6, 7))
    assert pii.fit(empty) is None and pii.find(empty, None).count() == 0
    same = pii.redact(docs, None)
    assert same.schema == docs.schema and same.count() == docs.count()


def test_masks_join_overlapping_spans():
    assert pii.mask("ab 123 cd", [(2, 3, 6), (3, 2, 5)]) == "ab[PHONE] cd" and pii.mask("x", []) == "x"


# --- op8


def slow_scores(rows):
    split = {i: [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())] for i, t in rows}
    counts = Counter()
    for i, t in rows:
        for n in (1, 2, 3):
            counts.update(zip(*[split[i][k:] for k in range(n)], strict=False))
    total = sum(len(split[i]) for i, _ in rows)
    out = {}
    for i, w in split.items():
        p, tally = 0.0, [0, 0, 0]
        for j in range(len(w)):
            most = k = min(3, j + 1)
            while k > 1 and counts[tuple(w[j - k + 1 : j + 1])] < 2:
                k -= 1
            gram = tuple(w[j - k + 1 : j + 1])
            p += math.log(counts[gram] / (counts[gram[:-1]] if k > 1 else total)) + (most - k) * math.log(0.4)
            tally[k - 1] += 1
        out[i] = (len(w), p, tally)
    return out


@pytest.mark.parametrize(("block", "bucket", "piece"), [(20_000_000, 8_000_000, 1_000_000), (20_000, 5_000, 1_000_000), (20_000, 50_000, 700)])
def test_backoff_scores_equal_brute_force(docs, block, bucket, piece):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected = slow_scores(rows)
    found = lm.score(docs, block_bytes=block, bucket_bytes=bucket, row_grams=0, piece_bytes=piece).collect()
    assert len(found) == len(rows)
    for r in found:
        n, p, tally = expected[r.doc_id]
        assert r.n_words == n and r.log_prob == pytest.approx(p, abs=1e-6) and [r.n_order1, r.n_order2, r.n_order3] == tally
        assert (r.score is None) == (n == 0)


@pytest.mark.parametrize(("text", "most", "context"), [(b"a b c d e f g", 7, 2), (b"one", 1, 2), (b" x  y " * 50, 20, 1), (b"x y z", 2, 0), (b"", 0, 2)])
def test_pieces_cover_a_text(text, most, context):
    found = [(n, part.split()) for n, part in lm.pieces(text, most, context)]
    assert [w for n, part in found for w in part[n:]] == text.split()
    for (_, a), (n, b) in itertools.pairwise(found):
        assert b[:n] == a[len(a) - n :] and n <= context and (n == context or n == len(a))


def test_packed_rows_stay_in_proportion():
    for size in (10**9, 10**12, 10**14):
        block, bucket = lm.block_and_bucket(size, 16_000_000, 8_000_000, 32)
        assert size / block * size / bucket <= size / 6 / 32 * 1.01 or (block, bucket) == (16_000_000, 8_000_000)


def test_scores_of_no_rows(empty):
    assert lm.score(empty).count() == 0


# --- op9


@pytest.mark.parametrize("weights", [[1], [1, 1], [5, 3, 2], [997, 1, 1, 1], [7, 11, 13, 17]])
def test_pfair_deviates_by_less_than_a_block(weights):
    slots = mixing.period(weights)
    total = sum(weights)
    assert sorted(s for own in slots for s in own) == list(range(total))
    for w, own in zip(weights, slots, strict=True):
        taken = set(own)
        n = 0
        for t in range(total):
            n += t in taken
            assert abs(n - w * (t + 1) / total) < 1
        assert all(k * total // w <= s < -(-(k + 1) * total // w) for k, s in enumerate(own))


def test_mixture_keeps_all_rows_and_follows_weights(spark):
    rows = [(i, "a" if i % 10 else None if i % 20 else "b", i) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, __n long")
    found = mixing.mix(docs.union(docs.limit(5)), {"a": 2, "b": 1, None: 1}, block_docs=4, bucket_rows=256).collect()
    assert len(found) == 3005 and len({r.mix_position for r in found}) == 3005
    first = sorted({(r.mix_slot, r.source) for r in found if r.mix_phase == 0}, key=lambda x: x[0])
    for name, share in (("a", 0.5), ("b", 0.25), (None, 0.25)):
        n = 0
        for t, (_, source) in enumerate(first):
            n += source == name
            assert abs(n - share * (t + 1)) < 1
    assert [r.mix_slot for r in sorted(found, key=lambda r: r.mix_position)] == sorted(r.mix_slot for r in found)
    assert mixing.mix(docs.where("false")).count() == 0


def test_mixture_of_clashing_names_and_many_sources(spark):
    names = ["row", "h", "bucket", "id", "of", "at", "offset", "place", "rank", "name", "starts", "base", "period", "slots", "block", "phase", "slot", "n", "mix_slot"]
    docs = spark.createDataFrame([(i, f"s{i % 3}", *[f"{n}{i}" for n in names]) for i in range(40)], "doc_id long, source string, " + ", ".join(f"{n} string" for n in names))
    found = mixing.mix(docs).collect()
    assert len({r.mix_position for r in found}) == 40 and all(r[n] == f"{n}{r.doc_id}" for r in found for n in names if n != "mix_slot")
    assert sorted(map(tuple, mixing.in_order(docs).collect())) == sorted(map(tuple, docs.collect()))
    kept = simhash.keep_documents(docs, docs.where("doc_id < 5").select("doc_id")).collect()
    assert sorted(map(tuple, kept)) == sorted(tuple(r) for r in docs.collect() if r.doc_id < 5)
    with pytest.raises(ValueError, match="more than 2 sources"):
        mixing.mix(docs, most_sources=2)


def test_one_source_and_order(spark):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("x").alias("source"))
    assert mixing.in_order(docs).count() == 100
    rows = [(1, "a"), (1, "a"), (None, None), (2, None), (3, "b")]
    assert sorted(map(str, mixing.in_order(spark.createDataFrame(rows, "doc_id long, source string")).collect())) == sorted(map(str, spark.createDataFrame(rows, "doc_id long, source string").collect()))


# --- op10


def slow_shards(rows, limit):
    """The shortest prefix of each hash whose documents fit."""
    hashed = [(i, n, format(h & (1 << 64) - 1, "064b")) for i, n, h in rows]
    out = {}
    for i, _, bits in hashed:
        for depth in range(65):
            if sum(n for _, n, b in hashed if b[:depth] == bits[:depth]) <= limit:
                out[i] = bits[:depth]
                break
        else:
            out[i] = None
    return out


@pytest.mark.parametrize("limit", [10**9, 3000, 400])
def test_shards_equal_brute_force(spark, limit):
    rng = random.Random(limit)
    docs = spark.createDataFrame([(i, "x" * rng.choice((0, 5, 90, 300))) for i in range(150)], "doc_id long, text string")
    hashes = docs.select("doc_id", F.length("text"), F.xxhash64("doc_id")).collect()
    found = sharding.shard(docs, limit).collect()
    expected = slow_shards([tuple(r) for r in hashes], limit)
    assert {r.doc_id: r.shard_id for r in found} == expected
    sums = Counter()
    for r in found:
        sums[r.shard_id] += r.n_bytes
    assert all(sums[r.shard_id] == r.shard_bytes <= limit for r in found)


def test_registered_shards_equal_brute_force(spark):
    found = queries.op10_extendible_shards(spark, "/root/testdata/sf0.01").collect()
    signed = lambda h: int(h, 16) - (1 << 64 if int(h, 16) >> 63 else 0)
    expected = slow_shards([(r.doc_id, r.n_bytes, signed(r.hash)) for r in found], queries.SHARD_BYTES)
    assert {r.doc_id: r.shard_id for r in found} == expected
    assert len({r.depth for r in found}) > 1 and all(r.shard_bytes <= queries.SHARD_BYTES for r in found)


def test_shards_of_one_hash_overflow(spark):
    docs = spark.createDataFrame([(7, "y" * 10)] * 200 + [(7, "z" * 500), (8, None), (None, "q")], "doc_id long, text string")
    found = sharding.shard(docs, 100).collect()
    assert len(found) == 203
    sums = Counter()
    for r in found:
        sums[r.shard_id] += r.n_bytes
    assert all(n <= 100 for n in sums.values() if n != 500) and 500 in sums.values()
    assert all(sums[r.shard_id] == r.shard_bytes for r in found)


def test_shards_of_no_rows(empty):
    assert sharding.shard(empty, 100).count() == 0
