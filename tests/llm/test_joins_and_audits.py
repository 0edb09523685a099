"""The Jaccard join, the filter audit and the source audit against brute force, with odd rows of every kind; documents of one doc_id."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import __spark_entry__
from tideloom.llm import divergence, interaction, parity, similar, simhash

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, part string, id long, key long, n int, bits int, term string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def frame(spark, texts, parts=3):
    """Rows of documents with columns whose names the operators use inside."""
    rows = [(i, t, "en" if i % 4 else None, f"s{i % 3}" if i % 7 else None, 0, "d", "p", 1, 2, 3, 4, "t") for i, t in texts]
    return spark.createDataFrame(rows, DOCS).repartition(parts)


def odd_texts():
    rng = random.Random(4)
    base = words(rng, 120)
    return [base, base, base.upper(), base + " tail", words(rng, 90), None, "", " \n\t ", "a", "a b", "a b", "a b c", "A B C", "a b c d e", "a b c d e f", "x" * 5000, words(rng, 30_000, 3000), "é   ü\x1c\x85 ǅ", "1 2 3 " * 400, None]


# --- op11


def slow_join(rows, percent=80, width=5):
    """doc_id -> (size of the set, smallest doc_id reachable), over all pairs of sets that share a shingle."""
    sets = {}
    for i, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    label, holders = {i: i for i in sets}, defaultdict(list)

    def root(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in holders[s])
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                label[b] = a
        for s in sets[i]:
            holders[s].append(i)
    return {i: (len(sets[i]), root(i)) for i in sets}


def joined(docs, **options):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in parity.join(docs, **options).collect()}


def edited(rng, base, share):
    copy = base.split()
    for _ in range(max(1, int(share * len(copy)))):
        copy[rng.randrange(len(copy))] = f"new{rng.randrange(9999)}"
    return " ".join(copy)


def near_copies_of(rng, bases, copies, low=5, high=300):
    out = []
    for _ in range(bases):
        base = words(rng, rng.randrange(low, high), 5000)
        out.append(base)
        out += [edited(rng, base, rng.choice([0.004, 0.01, 0.02, 0.03, 0.05])) for _ in range(copies)]
    return out


@pytest.mark.parametrize("crowd", [1, 3, 8])
@pytest.mark.parametrize(("bases", "copies"), [(60, 3), (4, 60)])
def test_join_equals_all_pairs(spark, crowd, bases, copies):
    rng = random.Random(bases)
    rows = list(enumerate(near_copies_of(rng, bases, copies)))
    truth = slow_join(rows)
    assert len({c for _, c in truth.values()}) < len(rows)
    assert joined(frame(spark, rows, 5), crowd=crowd, block_bytes=20_000) == truth


def test_join_of_short_texts_equals_all_pairs(spark):
    """Sets of few shingles leave segments empty and take further hashes."""
    rng = random.Random(2)
    texts = [words(rng, rng.randrange(1, 14), 6) for _ in range(300)]
    texts += [t + " " + words(rng, rng.randrange(1, 3), 6) for t in texts]
    rows = list(enumerate(texts))
    assert joined(frame(spark, rows)) == slow_join(rows)


@pytest.mark.parametrize("share", [0.3, 0.6, 0.85])
def test_join_behind_a_passage_equals_all_pairs(spark, share):
    """Every text holds one passage, so many of its keys are crowded; pairs near the threshold must still meet."""
    rng, passage, texts = random.Random(int(100 * share)), words(random.Random(9), int(200 * share), 5000), []
    for _ in range(120):
        own = words(rng, 200 - int(200 * share), 5000)
        texts += [passage + " " + own, passage + " " + edited(rng, own, 0.02), words(rng, 3, 9) + " " + passage + " " + edited(rng, own, 0.05)]
    rows = list(enumerate(texts))
    truth = slow_join(rows)
    assert joined(frame(spark, rows, 6), block_bytes=50_000) == truth and joined(frame(spark, rows, 1), crowd=2) == truth


@pytest.mark.parametrize("percent", [70, 90, 100])
def test_other_thresholds_equal_all_pairs(spark, percent):
    rows = list(enumerate(near_copies_of(random.Random(percent), 15, 6, 5, 120)))
    assert joined(frame(spark, rows), percent=percent) == slow_join(rows, percent)


def test_low_thresholds_are_refused(spark):
    with pytest.raises(ValueError, match="70 to 100"):
        parity.join(frame(spark, [(1, "a")]), percent=60)


def test_join_of_odd_and_no_rows(spark):
    rows = list(enumerate(odd_texts()))
    found = joined(frame(spark, [*rows, rows[0]]))
    assert found == slow_join(rows)
    assert [found[i] for i in (5, 6, 7)] == [(0, 5), (0, 6), (0, 7)] and found[10] == (1, 9)
    assert joined(frame(spark, rows).where("false")) == {}
    nameless = parity.join(spark.createDataFrame([(None, rows[0][1]), (3, rows[0][1]), (None, "alone here")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in nameless) == [(0, 0), (0, 3), (3, 3)]


def test_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 300)).astype(np.uint64))
        b = np.unique(np.r_[a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 62, 20).astype(np.uint64)])
        differing = len(np.setxor1d(a, b))
        assert sum((x ^ y).bit_count() for x, y in zip((v % (1 << 64) for v in parity.dense_sketch(a)), (v % (1 << 64) for v in parity.dense_sketch(b)), strict=True)) <= differing
        keys = [set(parity.segment_keys(x, 6, 0, 77).tolist()) for x in (a, b)]
        assert len(keys[0] - keys[1]) <= differing and len(keys[1] - keys[0]) <= differing


def test_every_similar_pair_shares_a_key():
    rng = np.random.default_rng(3)
    for n in [*range(1, 40), 63, 64, 65, 127, 128, 300]:
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        for gone in range(len(a) // 5 + 1):
            for more in range(5):
                b = np.unique(np.r_[a[gone:], rng.integers(0, 1 << 62, more).astype(np.uint64)])
                if 100 * (len(a) - gone) >= 80 * (len(b) + gone):
                    assert set(parity.band_keys(a, 80)[0].tolist()) & set(parity.band_keys(b, 80)[0].tolist())


def test_registered_join_equals_all_pairs(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    found = __spark_entry__.queries()["op11_parity_jaccard"](spark, FOLDER).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == slow_join([(r.doc_id, r.text) for r in docs]) and len(found) == len(docs)


# --- op12


def slow_audit(rows, labels):
    """rows (doc_id, text, source) and labels doc_id -> (quality, toxic), by going through every order."""
    texts = [(i, t or "", s or "") for i, t, s in rows]
    firsts = {}
    for i, t, _ in texts:
        if i is not None:
            firsts[t] = min(firsts.get(t, i), i)
    fails = []
    for i, t, _ in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails.append({"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and firsts[t] < i})
    found, removed_by = {}, Counter()
    for part in {s for _, _, s in texts}:
        mine = [k for k in range(len(texts)) if texts[k][2] == part]
        for order in itertools.permutations("ABCDE"):
            alive = list(mine)
            for step, f in enumerate(order, 1):
                gone = [k for k in alive if fails[k][f]]
                late = sum(fails[k][f] for k in mine) - len(gone)
                alive = [k for k in alive if not fails[k][f]]
                alone = sum(fails[k][f] and sum(fails[k].values()) == 1 for k in mine)
                lost = [sum(labels.get(texts[k][0], (0, 0))[x] == 1 for k in gone) for x in (0, 1)]
                found[part, "".join(order), step] = [len(alive), len(gone), late, alone, *lost]
                removed_by[part, f] += len(gone)
    return {k: tuple(v) + (removed_by[k[0], k[1][k[2] - 1]],) for k, v in found.items()}


def shown(audit):
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audit.collect()}


@pytest.mark.parametrize("share", [1000, 3])
def test_audit_equals_every_order(spark, share):
    """With share 3 a digest of over a third of the rows is salted."""
    rng = random.Random(6)
    texts = [*odd_texts(), *["one text " * 30] * 40, *[words(rng, rng.randrange(40, 70), rng.choice([20, 4000])).upper() for _ in range(20)], *[words(rng, 60, 9000) + rng.choice(["", " #", " &"]) for _ in range(30)]]
    rows = [*enumerate(texts), (None, "one text " * 30), (None, "no id"), (3, "a second text of one doc_id"), (3, texts[3])]
    rng.shuffle(rows)
    docs = frame(spark, [(i if i is not None else -1, t) for i, t in rows]).selectExpr("nullif(doc_id, -1) AS doc_id", *[c for c in ("text", "source", "digest", "part", "n", "bits")])
    labels = {i: (i % 2, int(i % 3 == 0)) for i in range(0, 90, 2)}
    table = spark.createDataFrame([(i, q, t, "x") for i, (q, t) in labels.items()] + [(200, 1, None, "x"), (4, None, None, "x")], "doc_id long, quality int, toxic int, part string")
    assert shown(interaction.audit(docs, table, share=share)) == slow_audit([(r.doc_id, r.text, r.source) for r in docs.collect()], labels)


def test_audit_with_a_full_bitmap_and_no_rows(spark):
    docs = frame(spark, [(i, f"text {i % 5}") for i in range(40)])
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert shown(interaction.audit(docs, labels, most_bits=6)) == slow_audit([(r.doc_id, r.text, r.source) for r in docs.collect()], {1: (1, 1)})
    assert interaction.audit(docs.where("false"), labels).count() == 0
    assert shown(interaction.audit(docs, labels.where("false")))["", "ABCDE", 1][4] == 0


# --- op13


def slow_divergence(rows, least=10, top=10):
    """rows (text, lang, source) -> (lang, source, part, item, value, rank), term by term."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = [t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups.add((lang, source))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    kept = {lang: sorted(t for t, n in docs[lang].items() if n >= least) for lang, _ in groups}
    sources = {lang: sorted(s for la, s in groups if la == lang) for lang in kept}

    def p(count, lang):
        total, v = sum(count[t] for t in kept[lang]), len(kept[lang])
        return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * v) for t in kept[lang]}

    def f(a, b):
        return (a - b) ** 2 // (a + b)

    out = set()
    for lang, names in sources.items():
        whole = p(sum((counts[lang, s] for s in names), Counter()), lang)
        for s in names:
            mine = p(counts[lang, s], lang)
            pairs = [(sum(f(mine[t], q) for t, q in p(counts[lang, o], lang).items()), o) for o in names if o != s]
            terms = [(f(mine[t], whole[t]), t) for t in kept[lang] if counts[lang, s][t] and mine[t] > whole[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, k) for k, (value, item) in enumerate(found[:most], 1)}
    return out


@pytest.mark.parametrize(("bucket_terms", "held"), [(65_536, 400_000), (20, 50)])
def test_divergence_equals_term_by_term(spark, bucket_terms, held):
    rng = random.Random(11)
    rows = []
    for i in range(600):
        lang, source = rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "d", None, ""])
        text = " ".join(rng.choice(["Wort", "straße", "ÄÖ", "x1y", "don't", f"t{chr(97 + min(25, int(rng.expovariate(0.2))))}{chr(97 + rng.randrange(8))}"]) for _ in range(rng.randrange(1, 60)))
        rows.append((text if i % 50 else None, lang, source))
    rows += [("lone words here", "xx", "only"), (None, "yy", "a"), ("", "yy", "b"), ("ab " * 40_000, "en", "a"), rows[3], rows[3]]
    docs = spark.createDataFrame([(*r, "t", 1, 2) for r in rows], "text string, lang string, source string, term string, p long, word long").repartition(4)
    found = [tuple(r) for r in divergence.audit(docs, bucket_terms=bucket_terms, held=held).collect()]
    assert set(found) == slow_divergence(rows) and len(found) == len(set(found))
    assert divergence.audit(docs.where("false")).count() == 0


def test_large_counts_stay_exact(spark):
    row = spark.createDataFrame([(10**14, 3 * 10**14, 7)], "c long, t long, v long").select(divergence.smoothed("c", "t", "v").alias("p")).first()
    assert row.p == 1 + 10**9 * (10**14 + 2) // (3 * 10**14 + 14)


@pytest.mark.parametrize("name", ["op12_filter_interaction", "op13_source_divergence"])
def test_audits_equal_sql(spark, name):
    link = duckdb.connect()
    for table in ("documents", "labels"):
        link.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    found = __spark_entry__.queries()[name](spark, FOLDER)
    answer = link.execute(__spark_entry__.oracle_sql()[name])
    assert found.columns == [c[0] for c in answer.description]
    assert sorted(map(tuple, found.collect())) == sorted(answer.fetchall())


# --- documents of one doc_id with several texts


@pytest.mark.parametrize("module", [similar, simhash])
def test_different_texts_of_one_doc_id_stay(spark, module):
    rng = random.Random(5)
    one, two, three = (words(rng, 80, 5000) for _ in range(3))
    rows = [(1, one), (1, two), (1, two), (2, two), (3, three), (3, three), (4, one), (None, one)]
    kept = module.keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(0, one), (1, one), (1, two), (3, three)])


def test_the_key_of_a_text_is_one_in_python_and_in_sql(spark):
    texts = [*odd_texts(), " a\tb ", "a b", "A  B\n", "\x0ba\x0cb\r", "a\xa0b", "a b ", "İ ǅ"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    found = rows.select("text", similar.word_id(rows["text"]).alias("id")).collect()
    assert [r.id for r in found] == [similar._text_id((r.text or "").encode()) for r in found]
