"""Divergence of sources, Merkle manifest and language-model scores against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.compare import database
from fleetvitals.llm import bloom, divergence, manifest, text

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, position int, value string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(*row, "x", 1, None) for row in rows], SCHEMA)


@pytest.fixture(scope="module")
def real():
    return database(FOLDER).sql("SELECT doc_id, text, lang, source, n_chars FROM documents ORDER BY 1").fetchall()


@pytest.fixture(scope="module")
def odd():
    """Nulls everywhere, empty and very long texts, very long terms, ties and repeated rows."""
    long = " ".join(f"Wort{chr(97 + i % 23)}{'x' * (i % 31)}" for i in range(30_000))
    rows = [
        (1, "Alpha beta alpha", "en", "a", 16), (2, "alpha Beta, gamma", "en", "b", 17), (3, "ALPHA delta", "en", "a", None), (4, None, "en", "c", 3),
        (5, "", "en", "c", 0), (6, long, "en", "b", len(long)), (7, long, "en", "a", len(long)), (8, long + " tail", "en", "b", 1), (8, long + " tail", "en", "b", 1),
        (8, "same id", "en", "b", 2), (None, "no id beta", "en", "a", 2), (None, "no id beta", "en", "a", 2), (9, "é🙂ß é🙂ß 漢字", None, None, 9),
        (10, "é🙂ß 漢字", None, "a", 2**63 - 1), (11, "é🙂ß 漢字 " + "q" * 5000, None, "", 4), (12, "q" * 5000, None, "a", 4), (13, "q" * 5000, "", "b", 4),
        (14, "lonely", "zz", "s", 6), (-15, "1 2 3", "de", "s", 5), (2**63 - 1, "x y", "de", "t", 5),
    ]
    return rows


# divergence


def brute_divergence(rows, least=3, top=200):
    counts, places, groups = defaultdict(Counter), defaultdict(set), set()
    for r, (_, body, lang, source, _) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for term in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", body or ""):
            term = term.translate(LOWER)
            counts[lang, source][term] += 1
            places[lang, term].add(r)
    out = []
    for lang, source in groups:
        kept = sorted(t for (at, t), found in places.items() if at == lang and len(found) >= least)
        peers = [s for at, s in groups if at == lang]
        n = {s: sum(counts[lang, s][t] for t in kept) for s in peers}
        p = {s: {t: 1 + 10**9 * (counts[lang, s][t] + 1) // (n[s] + len(kept)) for t in kept} for s in peers}
        both = {t: sum(counts[lang, s][t] for s in peers) for t in kept}
        q = {t: 1 + 10**9 * (both[t] + 1) // (sum(n.values()) + len(kept)) for t in kept}
        pairs = [(s, sum((p[source][t] - p[s][t]) ** 2 // p[s][t] for t in kept)) for s in peers if s != source]
        terms = [(t, (p[source][t] - q[t]) ** 2 // q[t]) for t in kept if counts[lang, source][t] and p[source][t] > q[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, rank) for rank, (item, value) in enumerate(found[:most], 1)]
    return Counter(out)


def test_divergence_odd_rows(spark, odd):
    got = divergence.divergence_query(docs(spark, odd))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert Counter(map(tuple, got.collect())) == brute_divergence(odd)


def test_divergence_many_buckets(spark, real, monkeypatch):
    """Small buckets, few held runs and blocks of few terms give the same rows."""
    wanted = brute_divergence(real)
    frame = docs(spark, real)
    assert Counter(map(tuple, divergence.source_divergence(frame).collect())) == wanted
    monkeypatch.setattr(divergence, "BUCKET_BYTES", 20_000)
    assert Counter(map(tuple, divergence.source_divergence(frame.repartition(7)).collect())) == wanted


def test_runs_merge():
    """Radix order, merging and both word widths, against a counter, with little room."""
    draw = np.random.default_rng(5)
    bodies = ["".join(draw.choice(list("abE é漢."), 60)) for _ in range(300)]
    import pyarrow as pa

    groups = draw.integers(0, 5, 300).astype(np.uint32)
    found = divergence.count_terms(text.text_bytes(pa.array(bodies)), groups)
    halves = [divergence.count_terms(text.text_bytes(pa.array(bodies[a : a + 150])), groups[a : a + 150]) for a in (0, 150)]
    counts = Counter()
    for body, group in zip(bodies, groups.tolist(), strict=True):
        counts.update((group, t.translate(LOWER).encode()) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", body))
    read = lambda width, r: {(int(g), divergence._item(width, t)): int(c) for g, t, c in zip(r.at, r.terms, r.counts, strict=True)}
    assert {k: v for w, r in found.items() for k, v in read(w, r).items()} == counts
    for width, runs in found.items():
        merged = divergence.Runs.merged([h[width] for h in halves if width in h])
        assert read(width, merged) == read(width, runs) and (merged.docs == runs.docs).all()
        keys = [divergence._item(width, t) for t in merged.terms]
        assert keys == sorted(keys)


def test_shares():
    counts = np.array([0, 1, 7, 10**12, 10**15], np.int64)
    for total in (1, 3, 10**15, 9 * 10**15):
        held = counts[counts <= total]
        assert divergence.shares(held, total).tolist() == [1 + 10**9 * int(c) // total for c in held]


# manifest


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def _tree(nodes):
    """All levels of a tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([_h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def brute_manifest(rows):
    leaf_of = lambda r, n: _h(*map(_field, (r[0], r[3], r[2], n, r[1])))
    by_lang = defaultdict(list)
    for row in rows:
        by_lang[row[2]].append((row, leaf_of(row, row[4])))
    langs = sorted(by_lang, key=lambda lang: (lang is not None, (lang or "").encode()))
    for members in by_lang.values():
        members.sort(key=lambda m: (m[0][0] is not None, m[0][0] or 0, m[1]))
    trees = {lang: _tree([leaf for _, leaf in by_lang[lang]]) for lang in langs}
    top = _tree([trees[lang][-1][0] for lang in langs])
    root = top[-1][0]
    out = []
    for place, lang in enumerate(langs):
        for at, (row, leaf) in enumerate(by_lang[lang]):
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[4] is not None
            digest, beside = leaf_of(row, row[4] + 1) if tampered else leaf, []
            for levels, i in ((trees[lang], at), (top, place)):
                for level in levels[:-1]:
                    other = level[i ^ 1 : (i ^ 1) + 1]
                    beside += other
                    digest = _h(*((other + [digest]) if i & 1 else ([digest] + other)))
                    i //= 2
            out.append((row[0], leaf, trees[lang][-1][0], root, _h(*beside), digest, digest == root))
    return Counter(out)


@pytest.mark.parametrize("digits", [1, 2, 12])
def test_manifest(spark, odd, digits):
    got = manifest.merkle_proofs(
        docs(spark, odd),
        {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1},
        (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull(),
        digits=digits,
    )
    assert Counter(map(tuple, got.collect())) == brute_manifest(odd)


def test_manifest_real_rows(spark, real):
    """Paths that pass through several records of the store; tampered rows don't verify, all others do."""
    rows = manifest.manifest_query(docs(spark, real)).collect()
    assert Counter(map(tuple, rows)) == brute_manifest(real)
    assert {r["verified"] for r in rows} == {True, False}
    one = manifest.merkle_proofs(docs(spark, real[:1])).first()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["proof_sha256"] == _h("")


# language model


def brute_model(rows, held, prior=bloom.PRIOR):
    """Scores by exact counts of words and pairs."""
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate(LOWER)), None] for r in rows]
    words = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    pairs = Counter(p for t, h in zip(tokens, held, strict=True) if not h for p in zip([None, *t[:-1]], t, strict=True))
    seen, known = sum(words.values()), len(words)
    out = []
    for t, h in zip(tokens, held, strict=True):
        share = lambda w: (words[w] + 1) / (seen + known + 1)
        base = sum(math.log10(share(w)) for w in t)
        count = lambda b, w: min(bloom.expected(np.array([pairs[b, w].bit_length()]))[0], words[b], words[w])
        score = sum(math.log10((count(b, w) + prior * share(w)) / (words[b] + prior)) for b, w in zip([None, *t[:-1]], t, strict=True))
        out.append((h, len(t), sum(words[w] > 0 for w in t), seen, base, score))
    return out


def _held(row):
    return row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 2


def test_language_model(spark, real, odd, monkeypatch):
    monkeypatch.setattr(bloom, "SEGMENT_TOKENS", 1 << 14)
    for rows in (real, odd):
        got = sorted(map(tuple, bloom.language_model_query(docs(spark, rows).repartition(3)).collect()), key=repr)
        wanted = sorted(((r[0], *b) for r, b in zip(rows, brute_model(rows, [_held(r) for r in rows]), strict=True)), key=repr)
        assert [g[:5] for g in got] == [w[:5] for w in wanted]
        for g, w in zip(got, wanted, strict=True):
            assert g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9)
            # the filter's false answers only
            assert g[6] == pytest.approx(w[6], rel=0.01)


def test_filter():
    """No entry is lost at any level, and unseen pairs pass rarely."""
    draw = np.random.default_rng(7)
    prints = np.unique(draw.integers(0, 1 << 40, 40_000).astype(np.uint64))
    seen, unseen = prints[::2], prints[1::2]
    counts = np.minimum(draw.zipf(1.5, len(seen)), 1 << 40)
    blob = bloom.filled(seen, counts)
    field, bits = np.frombuffer(blob, np.uint8), int.from_bytes(blob[-8:], "little")
    levels = bloom.probed(field, bits, seen)
    true = np.array([int(c).bit_length() for c in counts])
    assert (levels >= true).all() and (levels > true).mean() < 0.01
    assert (bloom.probed(field, bits, unseen) > 0).mean() < 0.01
    assert bloom.expected(np.array([0, 1, 2, 3])).tolist() == [0, 1, 2.5, 5.5]
    assert (bloom.quantised(np.arange(1, 2000)) == [n.bit_length() for n in range(1, 2000)]).all()
    assert bloom.probed(np.frombuffer(bloom.filled(prints[:0], counts[:0]), np.uint8), 64, unseen).max() == 0


def test_model_beats_words_alone_on_held_out_texts(spark, real):
    rows = bloom.language_model_query(docs(spark, real)).where("held_out").collect()
    assert len(rows) > 10 and sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_empty_tables(spark):
    none = docs(spark, [])
    for query in (divergence.divergence_query, manifest.manifest_query, bloom.language_model_query):
        assert query(none).count() == 0
    alone = docs(spark, [(2, None, None, None, None)])
    assert divergence.divergence_query(alone).count() == 0
    row = bloom.language_scores(alone, F.lit(True)).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"], row["score"]) == (1, 0, 0, 0.0, 0.0)


def test_labels_of_repeated_ids_give_one_row_each(spark):
    """The sample is bounded by ids even if the documents repeat them."""
    from fleetvitals.llm.labels import labelled_sample, sample_texts

    rows = docs(spark, [(i % 5, f"text {i}", "en", "a", 1) for i in range(500)])
    labels = spark.createDataFrame([(i, 1) for i in range(5)], "doc_id bigint, toxic int")
    got = sample_texts(rows, labelled_sample(labels, "toxic", 3, 1, 3)).collect()
    assert len(got) <= 3 and len({r["_text"] for r in got}) == len(got)
    assert got == sample_texts(rows.repartition(9), labelled_sample(labels, "toxic", 3, 1, 3)).collect() or len(got) > 1


def test_double_vectors_are_searched(spark):
    """Components of double precision are scored as they are."""
    from fleetvitals.llm import forest

    draw = np.random.default_rng(2)
    vectors = draw.standard_normal((60, 8))
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")
    got = forest.nearest_query(table).collect()
    for query in (0, 20, 40):
        score = (vectors * vectors[query]).sum(axis=1)
        wanted = sorted((i for i in range(60) if i != query), key=lambda i: -score[i])[:20]
        mine = sorted((r for r in got if r["query_id"] == query), key=lambda r: r["rank"])
        assert [r["vec_id"] for r in mine] == wanted and all(r["score"] == pytest.approx(score[r["vec_id"]], abs=1e-12) for r in mine)
