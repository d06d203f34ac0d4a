"""The pipeline as a plain-Python chain, the shards as a plain sort, the trees as a plain walk."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from checks.compare import database
from fleetvitals.llm import boosting, bpe, minhash, mixing, sharding, text, toxicity

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SPACE = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def rows():
    """The smallest documents with copies, near copies, nulls, empty and very long texts added."""
    real = database(FOLDER).sql("SELECT doc_id, text, lang, source, n_chars FROM documents ORDER BY 1").fetchall()
    long = " ".join(f"Wort{i % 977} und{i % 13}" for i in range(15_000))
    body = [w for w in real[3][1].split() if w]
    near = " ".join([*body[:-1], "other"])
    far = " ".join([*body[: len(body) // 2], *(f"new{i}" for i in range(len(body)))])
    more = [
        (1001, real[0][1], "en", "src0", 1), (1002, real[0][1], "en", None, 1), (1003, near, "fr", "src1", 2), (1004, far, "fr", "src1", 2),
        (1005, None, None, None, None), (1006, "", "en", "src2", 0), (1007, " \n ", "en", "zz", 3), (1008, long, "de", "big", 9), (1009, long + " end", "de", "big", 9),
        (1010, "one two three four five", "en", "src3", 5), (1011, "ONE two three four five", "en", "src3", 5), (1012, "é🙂 漢字 <|endoftext|> x", "zz", "ü", 4), (1013, near + " tail", "fr", "src1", 2),
    ]
    return real + more


def plain_components(kept):
    """Least id reachable over links of five-word shingles with a similarity of 0.8."""
    sets = {}
    for doc_id, body, *_ in kept:
        found = re.findall(SPACE, (body or "").translate(LOWER))
        sets[doc_id] = {tuple(found[i : i + 5]) for i in range(len(found) - 4)} if len(found) >= 5 else ({tuple(found)} if found else set())
    least = {d: d for d in sets}

    def top(d):
        while least[d] != d:
            d = least[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((top(a), top(b)))
                least[high] = low
    return {d: top(d) for d in ids}


def plain_copies(kept):
    """How often the mixture takes each document."""
    size = {r[0]: len(re.findall(SPACE, r[1] or "")) for r in kept}
    by_source = defaultdict(int)
    for r in kept:
        by_source[r[3]] += size[r[0]]
    order = sorted(by_source, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(by_source.values())
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if unit * weight[s] > 2 * by_source[s]}
        for s in over or open_:
            target[s] = 2.0 * by_source[s] if over else unit * weight[s]
        left -= sum(target[s] for s in over)
        open_ -= over or open_
    out = {}
    for doc_id, _, _, source, _ in kept:
        rate = target[source] / by_source[source] if by_source[source] else 0.0
        draw = int(hashlib.md5(f"{mixing.SEED} {doc_id}".encode()).hexdigest()[:13], 16) / (1 << 52)
        out[doc_id] = math.floor(rate) + (draw < rate - math.floor(rate))
    return out


def test_pipeline_equals_a_plain_chain(spark, rows, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")

    model = toxicity.train_toxicity(spark.createDataFrame(rows, SCHEMA), labels)
    kept = [r for r in rows if model.score(text.text_bytes(pa.array([r[1]], pa.string())))[0] < toxicity.THRESHOLD]
    first = {}
    for r in sorted(kept):
        first.setdefault(r[1] or "", r)
    kept = list(first.values())
    least = plain_components(kept)
    kept = [r for r in kept if least[r[0]] == r[0]]
    assert {0, 1004, 1005} <= {r[0] for r in kept} and not {1001, 1002, 1006, 1009, 1011} & {r[0] for r in kept}
    copies = plain_copies(kept)
    coder = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.VOCABULARY), special_tokens={})
    wanted = Counter()
    for doc_id, body, *_ in kept:
        ids = coder.encode_ordinary(body or "")
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        wanted[(doc_id, len(ids), digest, hashlib.sha256((body or "").encode()).hexdigest())] += copies[doc_id]
    assert Counter(map(tuple, corpus_pipeline.run(spark, folder).collect())) == +wanted


def test_pipeline_stages_on_no_rows_and_clashing_names(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    clash = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, size string, copies int, _row string"
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, spark.createDataFrame([], clash), folder)
        assert got.count() == 0
        assert name == "tokenize" or got.columns == spark.createDataFrame([], clash).columns
        got = stage(spark, spark.createDataFrame([(None, None, None, None, None, None, None, None, None), (1, "a b", "en", "s", 3, True, "x", 1, "y")], clash), folder)
        assert {1} <= {r["doc_id"] for r in got.collect()} or name == "mixing"


def test_near_groups_equal_brute_force(spark, rows):
    """Component ids of all rows, with the pipeline's five words."""
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_groups(spark.createDataFrame(rows, SCHEMA), width=5).collect()}
    assert got == plain_components(rows)


def test_shards_equal_a_plain_sort(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    drawn = frame.select("doc_id", "source", F.xxhash64(F.lit(sharding.SEED), "doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary"))).alias("d"))
    strata = defaultdict(list)
    for r in drawn.collect():
        strata["-" if r["source"] is None else "+" + r["source"]].append((r["d"], r["doc_id"]))
    ranked = sorted(
        ((2 * i + 1) / (2 * len(members)), stratum, draw, doc_id) for stratum, members in strata.items() for i, (draw, doc_id) in enumerate(sorted(members))
    )
    n, shards, wanted = len(ranked), sharding.SHARDS, {}
    for at, (*_, doc_id) in enumerate(ranked):
        shard = at * shards // n
        wanted[doc_id] = (shard, at - -(-shard * n // shards))
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.interleaved_shards(frame).collect()} == wanted


def test_tree_scores_equal_a_plain_walk(spark, rows):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    frame = spark.createDataFrame(rows, SCHEMA)
    model = boosting.train_quality(frame, labels)
    got = {r["doc_id"]: r["score"] for r in boosting.score_quality(frame, model).collect()}
    depth = int(np.log2(model.feature.shape[1] + 1))
    for doc_id, body, *_ in rows:
        x = boosting.statistics(text.text_bytes(pa.array([body], pa.string())))[0]
        margin = model.base
        for feature, threshold, value in zip(model.feature, model.threshold, model.value, strict=True):
            node = 0
            for _ in range(depth):
                node = 2 * node + (2 if x[feature[node]] > threshold[node] else 1)
            margin += value[node - len(feature)]
        assert got[doc_id] == pytest.approx(1 / (1 + math.exp(-min(max(margin, -30), 30))), abs=1e-9), doc_id
