"""Operators for training data against brute force, on hand-made rows and the smallest tables."""

import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

import __spark_entry__ as contract
import corpus_pipeline
from checks.compare import database, differences
from fleetvitals.llm import bpe, counts, divergence, exact, forest, minhash, mixing, queries, sharding, suffixes, text, toxicity

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, size string"
VECTORS = "vec_id bigint, embedding array<float>, label int, score string"


def docs(spark, rows):
    """Documents with two extra columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "en", s, None, True, "x") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def real():
    return database(FOLDER).sql("SELECT doc_id, text FROM documents ORDER BY 1").fetchall()


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"word{i % 977}" for i in range(40_000))
    rows = [
        (1, "A b c d e f", "s"), (2, "A b c d e f", "s"), (3, None, None), (4, "", "t"), (5, " \n\t ", None), (6, long, "s"),
        (7, long + " tail", "t"), (8, "one", "t"), (8, "one", "t"), (9, "two words", "s"), (None, "A b c d e f", "s"), (None, None, None), (10, "é🙂 ß", "s"),
    ]
    return docs(spark, rows)


def by_id(frame):
    return {row["doc_id"]: row.asDict() for row in frame.collect()}


def test_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(contract.queries())
    assert {name.split("_")[0] for name in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    count, found = differences(queries.QUERIES[name](spark, FOLDER), database(FOLDER), name)
    assert not found and count > 0


def test_empty_tables(spark):
    none = docs(spark, [])
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    for query in (exact.exact_dedup_query, sharding.sharding_query, mixing.mixing_query, minhash.near_dedup_query, suffixes.suffix_query, bpe.bpe_query, counts.token_counts_query):
        assert query(none).count() == 0
    assert queries.quality_query(none, labels).count() == 0
    assert toxicity.toxicity_query(none, labels).count() == 0
    assert forest.nearest_query(spark.createDataFrame([], VECTORS)).count() == 0


def test_exact(spark, odd):
    rows = [r.asDict() for r in exact.exact_dedup_query(odd).collect()]
    assert len(rows) == 13
    found = {r["doc_id"]: r for r in rows}
    assert (found[1]["keep_id"], found[1]["group_size"], found[1]["kept"], found[2]["kept"]) == (2, 3, False, True)
    assert found[3]["keep_id"] == 4 and found[4]["kept"]
    assert found[6]["group_size"] == 1 and found[8]["group_size"] == 2
    assert found[10]["text_sha256"] == hashlib.sha256("é🙂 ß".encode()).hexdigest()
    left = exact.drop_copies(odd, keep="smallest")
    assert left.columns == odd.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 3, 5, 6, 7, 8, 9, 10]


def test_sharding(spark, real, odd):
    for frame, n in ((docs(spark, [(i, t, f"s{i % 3}") for i, t in real]), len(real)), (odd, 13)):
        rows = sharding.sharding_query(frame).collect()
        sizes = np.bincount([r["shard"] for r in rows], minlength=24)
        assert len(rows) == n and sizes.max() - sizes.min() <= 1
        for shard in range(24):
            assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sizes[shard]))
        assert sorted(map(str, rows)) == sorted(map(str, sharding.sharding_query(frame.repartition(3)).collect()))
    rows = sharding.sharding_query(docs(spark, [(i, t, f"s{i % 3}") for i, t in real])).collect()
    assert all(r["size"] == len(t.encode()) + 8 and r["text_crc32"] == zlib.crc32(t.encode()) for r in rows for t in [dict(real)[r["doc_id"]]])
    for source in ("s0", "s1", "s2"):
        # every shard has its share of a source, to within one row
        mine = np.bincount([r["shard"] for r in rows if r["source"] == source], minlength=24)
        assert mine.max() - mine.min() <= 2


def test_mixing(spark, odd):
    found = by_id(mixing.mixing_query(odd))
    assert found[3]["taken"] == 0 and found[4]["size"] == 0
    assert all(r["taken"] <= 2 * r["size"] and r["target"] <= 2 * r["source_size"] for r in found.values())
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 10), (None, 500)], "_source string, source_size bigint")
    targets = {r["_source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    # 2415 words: a and c stop at twice their size; b : null = 2 : 5 share the rest until null stops at 1000
    assert targets == {"a": 200.0, "b": pytest.approx(1195.0), "c": 20.0, None: 1000.0}


def brute_components(rows, width, percent):
    table = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    sets = {}
    for i, t in rows:
        w = (t or "").encode().translate(table).split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near(spark, real, odd):
    rng = np.random.default_rng(5)
    base = [f"w{rng.integers(4000)}" for _ in range(300)]
    # chains and a group whose members are near the threshold
    rows = list(real)
    for k in range(60):
        words = list(base)
        for at in rng.choice(300, 1 + k % 14, replace=False):
            words[at] = f"n{k}x{at}"
        rows.append((100_000 + k, " ".join(words)))
    rows += [(200_000, "Same Words"), (200_001, "same\twords"), (200_002, ""), (200_003, "solo")]
    for width in (2, 5):
        found = by_id(minhash.near_groups(docs(spark, [(i, t, "s") for i, t in rows]), width=width))
        wanted = brute_components(rows, width, 80)
        assert {i: (r["n_shingles"], r["component_id"]) for i, r in found.items()} == wanted
    strange = minhash.near_groups(odd, width=2).collect()
    assert len(strange) == 13
    found = {r["doc_id"]: r for r in strange if r["doc_id"] is not None}
    assert found[2]["component_id"] == 1 and found[7]["component_id"] == 6 and found[3]["component_id"] == 3 and found[4]["kept"]
    assert all(r["kept"] and r["component_id"] is None for r in strange if r["doc_id"] is None)
    assert minhash.drop_near_copies(odd, width=2).columns == odd.columns


def test_blocks_across_batches():
    rng = np.random.default_rng(8)
    base = rng.choice(1 << 40, 100, replace=False)
    rows = []
    for group in range(6):
        for m in range(3 + 9 * group):
            own = np.sort(np.append(base[: 100 - rng.integers(30)], rng.integers(1 << 40, 1 << 41, 3)))
            rows.append({"l": group, "i": 0, "low": 0, "high": 0, "piece": 0, "m": 100 * group + m, "n": len(own), "c": 100 * group + m, "left": [group], "right": [1], "shingles": own.tolist()})
    names = {"piece": pa.int32(), "i": pa.int32(), "low": pa.int32(), "high": pa.int32(), "left": pa.list_(pa.int64()), "right": pa.list_(pa.int64()), "shingles": pa.list_(pa.int64())}
    table = pa.Table.from_pylist(rows, pa.schema([(c, names.get(c, pa.int64())) for c in rows[0]]))
    wanted = set()
    for a in rows:
        for b in rows:
            both = len(set(a["shingles"]) & set(b["shingles"]))
            if a["l"] == b["l"] and a["m"] < b["m"] and 100 * both >= 80 * (a["n"] + b["n"] - both):
                wanted.add((a["m"], b["m"]))
    assert wanted
    for size in (1, 2, 7, 20, 1000):
        made = minhash._compared(1, 80)(iter(table.to_batches(max_chunksize=size)))
        assert {(x, y) for batch in made for x, y in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True)} == wanted


def brute_repeats(rows):
    first, out = {}, {}
    for i, t in sorted(rows):
        data = (t or "").encode()
        gone = np.zeros(len(data), dtype=bool)
        for k in range(len(data) - 49):
            if first.get(data[k : k + 50], i) < i:
                gone[k : k + 50] = True
        for k in range(len(data) - 49):
            first.setdefault(data[k : k + 50], i)
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[i] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_repeats(spark, real):
    passage = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(120))
    rows = list(real)
    # a passage at every offset, cut to lengths around the limit, inside runs of one letter, and in itself
    rows += [(10_000 + k, "x" * k + passage[: 40 + k] + f"-{k}") for k in range(40)]
    rows += [(20_000, "ab" * 100), (20_001, "ab" * 60), (20_002, passage * 3), (20_003, None), (20_004, passage[:50]), (20_005, passage[:49])]
    found = by_id(suffixes.suffix_query(docs(spark, [(i, t, "s") for i, t in rows])))
    assert {i: tuple(r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for i, r in found.items()} == brute_repeats(rows)


def test_cover():
    differences = {(a - b) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER}
    assert differences == set(range(suffixes.PERIOD))


def test_bpe(spark, real, odd):
    ranks = bpe.load_ranks(bpe.VOCABULARY)
    library = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = by_id(bpe.bpe_query(docs(spark, [(i, t, "s") for i, t in real])))
    for i, t in real:
        ids = library.encode_ordinary(t)
        assert found[i]["n_tokens"] == len(ids)
        assert found[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert found[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert bpe.bpe_query(odd).count() == 13
    back = by_id(bpe.decode(bpe.encode(odd)))
    assert back[10]["text"] == "é🙂 ß" and back[3]["text"] == ""
    coder, rng = bpe.codec(), np.random.default_rng(3)
    parts = ["a", " ", "  ", "\n", "\t", "é", "'s", "'", "1", "...", "　", "\x1c", "\x85", "語", "🙂", " the", "A", "\r\n", "\xa0"]
    for _ in range(3000):
        t = "".join(rng.choice(parts, rng.integers(0, 30)))
        assert coder.encode(t) == library.encode_ordinary(t)
    stream = bpe.Utf8Stream()
    data = "aé語🙂z".encode()
    assert "".join(stream.feed(data[i : i + 1]) for i in range(len(data))) + stream.close() == "aé語🙂z"


def test_transducer_resets(monkeypatch):
    ranks = bpe.load_ranks(bpe.VOCABULARY)
    monkeypatch.setattr(bpe, "MEMORY_STATES", 5)
    small, large = bpe.MergeTransducer(ranks), bpe.codec().transducer
    for word in ("tokenization", " unbelievable", "aaaaaaaaaaaa", " Straße", "\n\n\n"):
        assert small.encode(word.encode()) == large.encode(word.encode())


def test_token_counts(spark, real, odd):
    scores = counts.rank_scores(counts.load_ranks(counts.VOCABULARY))
    counter = counts.counter(counts.VOCABULARY, counts.PATTERN)

    def brute(data):
        best = [(0.0, 0)]
        for end in range(1, len(data) + 1):
            ways = [(best[s][0] + scores[data[s:end]], -best[s][1] - 1) for s in range(end) if data[s:end] in scores]
            score, n = max(ways)
            best.append((score, -n))
        return best[-1][1]

    found = by_id(counts.token_counts_query(docs(spark, [(i, t, "s") for i, t in real[:30]])))
    for i, t in real[:30]:
        pieces = counter.split(t)
        assert (found[i]["n_pretokens"], found[i]["n_tokens"]) == (len(pieces), sum(brute(p.encode()) for p in pieces))
    assert by_id(counts.token_counts_query(odd))[3]["n_tokens"] == 0


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1500, 16)).astype(np.float32) * rng.uniform(0.2, 3, (1500, 1)).astype(np.float32)
    x[100:160] = x[0]
    rows = [(i, [float(v) for v in row], 0, "x") for i, row in enumerate(x)]
    strange = [(2000, None, 0, "x"), (2020, [0.0] * 16, 0, "x"), (2040, [float("nan")] * 16, 0, "x"), (2060, [1.0, None], 0, "x"), (2080, [], 0, "x"), (None, [1.0] * 16, 0, "x")]
    frame = spark.createDataFrame(rows + strange, VECTORS)
    got = {}
    for r in forest.nearest(frame, frame.vec_id % 20 == 0, block=500, candidates=250).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 1500, 20))
    hits, d = 0, x.astype(np.float64)
    for q, found in got.items():
        scores = d @ d[q]
        scores[q] = -np.inf
        wanted = np.lexsort((np.arange(1500), -scores.round(9)))[:20]
        hits += len(set(wanted) & {v for v, _ in found})
        assert [s for _, s in found] == pytest.approx(sorted((s for _, s in found), reverse=True))
        assert len(found) == 20 and all(s == pytest.approx(d[q] @ d[v]) for v, s in found)
    assert hits / (20 * len(got)) >= 0.9
    few = spark.createDataFrame(rows[:5], VECTORS)
    assert [r["rank"] for r in forest.nearest_query(few).orderBy("rank").collect()] == [1, 2, 3, 4]


def recall(frame, x, **kwargs):
    """Share of the brute-force nearest that are found by ``nearest`` for every 20th row of unlike vectors."""
    rows = forest.nearest(frame, frame.vec_id % 20 == 0, **kwargs).collect()
    got = {}
    for r in rows:
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    assert len(got) == -(-len(x) // 20) and all(len(f) == 20 for f in got.values()) and len(rows) == 20 * len(got)
    hits, d = 0, x.astype(np.float64)
    for q, found in got.items():
        scores = d @ d[q]
        scores[q] = -np.inf
        hits += len(set(np.argsort(-scores)[:20].tolist()) & set(found))
        assert all(s == pytest.approx(scores[v]) for v, s in found.items())
    return hits / (20 * len(got))


@pytest.mark.parametrize("sigma", [0, 0.15, 0.5])
def test_nearest_full_block(spark, sigma):
    # production parameters on one full block of clusters, lengths alike or log-normal
    rng = np.random.default_rng(7)
    x = rng.standard_normal((40, 64))[rng.integers(40, size=forest.BLOCK)] + 2.5 * rng.standard_normal((forest.BLOCK, 64))
    x = (x / np.linalg.norm(x, axis=1)[:, None] * np.exp(sigma * rng.standard_normal((len(x), 1)))).astype(np.float32)
    table = pa.table({"vec_id": pa.array(range(len(x)), pa.int64()), "embedding": pa.array(list(x), pa.list_(pa.float32()))})
    assert recall(spark.createDataFrame(table), x) >= 0.9


def test_counting_terms_is_bounded(spark):
    """A task's memory doesn't grow with its texts, and long rows come to Python in batches of bounded size."""
    rng = np.random.default_rng(3)
    some = ["".join(" %x" % n for n in rng.integers(1 << 40, 1 << 44, size=200)).translate(str.maketrans("0123456789", "ghijklmnop")) for _ in range(8000)]
    batches = [pa.record_batch([pa.array(["x"] * 1000), pa.array(["s"] * 1000), pa.array(some[i : i + 1000])], ["lang", "source", "text"]) for i in range(0, 8000, 1000)]
    tracemalloc.start()
    for _ in divergence._counted(8)(iter(batches)):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 160 << 20
    sizes = spark.range(0, 64, 1, 1).selectExpr("repeat('x', 1000000) AS x").mapInArrow(
        lambda batches: (pa.record_batch([pa.array([b.num_rows])], ["n"]) for b in batches), "n long"
    )
    assert max(r["n"] for r in sizes.collect()) <= 6


def test_ascent(monkeypatch):
    """The ascent finds what single steps over all strings find, and begins at the longest prefix there is."""
    rng = np.random.default_rng(9)
    keys, wanted = (rng.integers(0, 1 << forest.BITS, size=(n, forest.TREES)) for n in (500, 40))
    wanted[0], wanted[1, 0] = keys[7], keys[8, 0] ^ 1
    made = forest.Forest(keys)
    alike = np.array([[max(forest.BITS - int(a ^ b).bit_length() for a in keys[:, t]) for t, b in enumerate(row)] for row in wanted])
    by_string = np.argsort(wanted, axis=0, kind="stable")
    assert (made.depths(np.take_along_axis(wanted, by_string, axis=0).T) == np.take_along_axis(alike, by_string, axis=0).T).all()
    levels, ranges = [], made.ranges
    monkeypatch.setattr(made, "ranges", lambda strings, level: levels.append(level) or ranges(strings, level))
    for row, best, found in zip(wanted, alike.max(axis=1), made.candidates(wanted, 300), strict=True):
        for level in range(best, -1, -1):
            met = keys >> (forest.BITS - level) == row >> (forest.BITS - level)
            if met.sum() >= 300:
                break
        assert found.tolist() == np.flatnonzero(met.any(axis=1)).tolist()
    assert levels == sorted(set(levels), reverse=True) and levels[0] == alike.max()


def test_nearest_pieces(spark, monkeypatch):
    # both sides of every task are bounded, and pieces find what one piece finds
    rng = np.random.default_rng(8)
    x = (rng.standard_normal((2000, 16)) * np.exp(0.5 * rng.standard_normal((2000, 1)))).astype(np.float32)
    frame = spark.createDataFrame([(i, [float(v) for v in row], 0, "x") for i, row in enumerate(x)], VECTORS)
    searched = forest._searched

    def bounded(*args):
        run = searched(*args)

        def check(key, points, queries):
            assert points.num_rows <= 400 and queries.num_rows <= 40
            return run(key, points, queries)

        return check

    results = [sorted(map(tuple, forest.nearest(frame, frame.vec_id % 20 == 0, block=300, candidates=250).collect()))]
    monkeypatch.setattr(forest, "_searched", bounded)
    results.append(sorted(map(tuple, forest.nearest(frame, frame.vec_id % 20 == 0, block=300, candidates=250, piece=20).collect())))
    assert results[0] == results[1]
    assert recall(frame, x, block=300, candidates=250, piece=20) >= 0.9


def test_length_bands():
    # neighbours are put together while they are small; norms are the greatest length of a group
    assert forest._groups([], 160) == []
    assert forest._groups([(-3, 4, 0.5), (-2, 6, 0.6), (0, 1, 1.0), (1, 200, 1.1), (2, 3, 1.2)], 160) == [
        (-3, 0, 1, 0.6), (-2, 0, 1, 0.6), (0, 1, 1, 1.0), (1, 2, 2, 1.1), (2, 4, 1, 1.2)
    ]


def test_classifiers(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r[0]: r[1:] for r in database(folder).sql("SELECT doc_id, quality, toxic FROM labels").fetchall()}
    for name, at, least in (("op1_quality", 0, 0.95), ("op7_toxicity", 1, 0.9)):
        rows = queries.QUERIES[name](spark, folder).collect()
        assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
        folds, out = ((4, 2), (3, 1))[at]
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == out) for r in rows)
        held = [r["predicted"] == labels[r["doc_id"]][at] for r in rows if r["held_out"] and r["doc_id"] in labels]
        assert sum(held) / len(held) >= least


def test_toxic_words_are_learned(spark):
    rng = np.random.default_rng(4)
    rows, marks = [], []
    for i in range(600):
        words = [f"plain{rng.integers(300)}" for _ in range(40)]
        if i % 8 == 0:
            words[3] = f"grumbly{rng.integers(30)}"
        rows.append((i, " ".join(words), "s"))
        marks.append((i, 1, int(i % 8 == 0)))
    rows.append((10_000, None, None))
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    found = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity_query(docs(spark, rows), labels).collect()}
    assert found == {i: int(i < 600 and i % 8 == 0) for i in found} and len(found) == 601
    clean = toxicity.drop_toxic(docs(spark, rows), toxicity.train_toxicity(docs(spark, rows), labels))
    assert clean.count() == 601 - 75 and clean.columns == docs(spark, []).columns


def test_toxic_terms_of_every_kind(spark):
    # a word of three bytes, a word that begins a clean one, an inner part of a run, a phrase of common words
    rng = np.random.default_rng(6)
    signs = [chr(0x4E00 + i) for i in range(200)]

    def made(kind):
        words = [f"plain{rng.integers(300)}" for _ in range(40)]
        run = "".join(rng.choice(signs, 12))
        words[5], words[10], words[20] = "grumble", "calm", "river"
        if kind == 0:
            words[30] = "zog"
        if kind == 1:
            words[30] = "grum"
        if kind == 2:
            run = run[:5] + "\u6bd2\u820c" + run[5:]
        if kind == 3:
            words[30:32] = "calm", "river"
        return " ".join([*words, run])

    kinds = [i % 24 for i in range(1200)]
    rows = [(i, made(kind), "s") for i, kind in enumerate(kinds)]
    labels = spark.createDataFrame([(i, 1, int(kind < 4)) for i, kind in enumerate(kinds)], "doc_id bigint, quality int, toxic int")
    found = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity_query(docs(spark, rows), labels).collect()}
    for kind in range(24):
        assert {found[i] for i in found if kinds[i] == kind} == {int(kind < 4)}, kind


def test_runs_match_python():
    rows = ["", "a\u4e00\u4e01\u4e02b\u4e03", None, "\u4e00\u4e01", "\u00e4\u00f6"]
    for size, (hashes, owner) in zip((1, 2, 4), text.runs(text.text_bytes(pa.array(rows)), (1, 2, 4)), strict=True):
        assert owner.tolist() == {1: [1, 1, 1, 1, 3, 3], 2: [1, 1, 3], 4: []}[size]
        if size == 2:
            assert hashes[0] == hashes[2] != hashes[1]


def test_pipeline(spark):
    ids = {row[0] for row in database(FOLDER).sql("SELECT doc_id FROM documents").fetchall()}
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, frame, FOLDER)
        assert got.columns == frame.columns, name
    result = corpus_pipeline.run(spark, FOLDER).collect()
    assert result and {r["doc_id"] for r in result} <= ids


def test_words_match_python():
    rows = ["", "A b", " x\ty \n", "ÄÖ a" * 3, None, "one"]
    found = text.words(text.text_bytes(pa.array(rows)))
    assert np.diff(found.first).tolist() == [len((t or "").encode().split()) for t in rows]


def test_far_into_a_piece_walks_are_followed_without_new_states():
    """States are made for the first bytes of a piece only; the tokens are those of plain merging."""
    coder, chance = bpe.codec(), random.Random(5)
    made = coder.transducer
    letters = ["aeiourstln", "aéèàuxr", "ab", "日本語абв", "0123456789.,!?'"]
    pieces = ["".join(chance.choices(chance.choice(letters), k=chance.randrange(1, 60))) for _ in range(600)]
    for piece in ["a" * 3000, "ab" * 1500, *pieces]:
        data = piece.encode()
        if len(data) < 400:
            assert made.encode(data) == [made.ranks[token] for token in made._merge(data, len(data))]
        assert b"".join(made.data[token] for token in made.encode(data)) == data
        assert coder.encode(f"x {piece}") == coder._pieces(f"x {piece}")
    fresh = bpe.MergeTransducer(made.ranks)
    for piece in pieces:
        fresh.encode(piece.encode())
        before = len(fresh._states)
        fresh.encode(f"{piece[:1]}{piece}".encode())
        assert len(fresh._states) - before <= bpe.DETERMINISED
