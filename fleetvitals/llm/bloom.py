"""Language-model scores from n-gram counts held in a log-frequency Bloom filter."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetvitals.llm.text import mix64, numbers, slices, text_bytes, words
from fleetvitals.plans import durable

# Observations that the word's own share counts as, beside those of its history.
PRIOR = 300.0
# Bits of the filter for each entry, and probes for each.
ENTRY_BITS = 12
PROBES = 8
# Text encoded as one block, tokens per segment of the model, and counts a task holds before it emits them.
BLOCK_BYTES = 8 << 20
SEGMENT_TOKENS = 1 << 20
HELD_COUNTS = 2_000_000

# Hash of the token that ends every text and stands before its first word.
END = np.uint64(0xD1B54A32D192ED03)
_FINGERPRINT = np.uint64((1 << 40) - 1)
_SALT = numbers(13, 2)
_MOST_LEVELS = 64

_BLOCK = "block bigint, ids array<bigint>, held_out array<boolean>, ends binary, vocabulary binary, n_tokens bigint, tokens binary"
_COUNTS = "segment bigint, words binary, word_counts binary, grams binary, gram_counts binary"
_MODEL = "segment bigint, n_words bigint, n_seen bigint, words binary, word_counts binary, filter binary"
_ANSWERS = "block bigint, segment bigint, word_counts binary, levels binary"
_SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


@contextmanager
def _few_rows(spark: SparkSession, rows: int):
    """Arrow batches of few rows while an eager step runs over rows of some MB each."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _packed(numbers_: np.ndarray) -> bytes:
    """Whole numbers in the least width that holds them all, which the first byte names."""
    top = int(numbers_.max()) if len(numbers_) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w))
    return bytes([width]) + numbers_.astype(f"u{width}").tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, dtype=f"u{blob[0]}", offset=1).astype(np.int64)


def _prints(hashes: np.ndarray) -> bytes:
    """40 bits of each hash; its segment is named by others."""
    low = hashes & _FINGERPRINT
    return (low & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + (low >> np.uint64(32)).astype(np.uint8).tobytes()


def _of_prints(blob: bytes) -> np.ndarray:
    n = len(blob) // 5
    return np.frombuffer(blob, np.uint32, n).astype(np.uint64) | np.frombuffer(blob, np.uint8, n, 4 * n).astype(np.uint64) << np.uint64(32)


def _cuts(hashes: np.ndarray, segments: int) -> Iterator[tuple[int, int, int]]:
    """(segment, first, end) of sorted hashes; segments are equal ranges of the upper 32 bits."""
    if not len(hashes):
        return
    at = (hashes >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)
    first = np.flatnonzero(np.diff(at, prepend=np.uint64(segments)))
    yield from zip(at[first].tolist(), first.tolist(), np.append(first[1:], len(at)).tolist(), strict=True)


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as numbers of words in the block's own vocabulary, so that later steps read no text."""
    task = TaskContext.get()
    number, ids, held, hashes, sizes, room = task.partitionId() << 31, [], [], [], [], 0

    def block() -> pa.RecordBatch:
        vocabulary, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
        ends = np.cumsum(np.concatenate(sizes))
        packed = pa.compress(tokens.astype(np.uint32).tobytes(), codec="zstd", asbytes=True)
        values = [number, ids, held, ends.tobytes(), vocabulary.tobytes(), len(tokens), packed]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
        names = ["block", "ids", "held_out", "ends", "vocabulary", "n_tokens", "tokens"]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

    for batch in batches:
        table = pa.Table.from_batches([batch])
        batch_ids, batch_held = table["doc_id"].to_pylist(), table["held_out"].to_pylist()
        for first, end, some in slices(text_bytes(table["text"])):
            found = words(some)
            hashes.append(np.insert(found.hashes, found.first[1:], END))
            sizes.append(np.diff(found.first) + 1)
            ids += batch_ids[first:end]
            held += batch_held[first:end]
            room += len(some.data)
            if room >= BLOCK_BYTES:
                yield block()
                number, ids, held, hashes, sizes, room = number + 1, [], [], [], [], 0
    if ids:
        yield block()


class _Block:
    """An encoded block: tokens by number, words by hash, and the hashes of all pairs of neighbours."""

    def __init__(self, row: dict):
        self.ends = np.frombuffer(row["ends"], np.int64)
        self.vocabulary = np.frombuffer(row["vocabulary"], np.uint64)
        self.tokens = np.frombuffer(pa.decompress(row["tokens"], 4 * row["n_tokens"], codec="zstd", asbytes=True), np.uint32)
        self.held_out = np.array(row["held_out"], bool)
        # the end of the text before stands before the first word
        self.before = np.empty_like(self.tokens)
        self.before[1:], self.before[:1] = self.tokens[:-1], self.tokens[-1:]
        self.grams = mix64(mix64(self.vocabulary ^ _SALT[0])[self.before] + (self.vocabulary * _SALT[1])[self.tokens])


def _one_by_one(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sum of their counts."""
    keys, counts = (np.concatenate(c) for c in zip(*parts, strict=True))
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0)
    return keys[first], np.add.reduceat(counts, first)


def _trained(segments: int):
    """Counts of words and pairs of a task's training texts, merged before they are shuffled."""

    def emitted(held_words, held_grams) -> Iterator[pa.RecordBatch]:
        rows: dict[int, list[bytes]] = {}
        (w, wc), (g, gc) = _summed(held_words), _summed(held_grams)
        for segment, a, b in _cuts(w, segments):
            rows.setdefault(segment, [b""] * 4)[:2] = [w[a:b].tobytes(), _packed(wc[a:b])]
        for segment, a, b in _cuts(g, segments):
            rows.setdefault(segment, [b""] * 4)[2:] = [_prints(g[a:b]), _packed(gc[a:b])]
        names = ["words", "word_counts", "grams", "gram_counts"]
        columns = [pa.array(list(rows), pa.int64()), *(pa.array([r[i] for r in rows.values()], pa.binary()) for i in range(4))]
        yield from pa.table(columns, names=["segment", *names]).to_batches(max_chunksize=1000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        held_words, held_grams, held = [none], [none], 0
        for batch in batches:
            for row in _one_by_one(batch):
                block = _Block(row)
                train = np.repeat(~block.held_out, np.diff(block.ends, prepend=0))
                counts = np.bincount(block.tokens[train], minlength=len(block.vocabulary))
                held_words.append((block.vocabulary[counts > 0], counts[counts > 0]))
                held_grams.append(np.unique(block.grams[train], return_counts=True))
                held += len(held_grams[-1][0])
                if held > HELD_COUNTS:
                    yield from emitted(held_words, held_grams)
                    held_words, held_grams, held = [none], [none], 0
        yield from emitted(held_words, held_grams)

    return run


def _place(prints: np.ndarray, level: int, probe: int, bits: int) -> np.ndarray:
    """The bit of the filter that stands for a fingerprint at a level, in one of its probes."""
    mixed = mix64(prints + np.uint64(level * int(_SALT[0]) % (1 << 64)))
    step = mix64(mixed ^ _SALT[1]) | np.uint64(1)
    return ((mixed + step * np.uint64(probe)) % np.uint64(bits)).astype(np.int64)


def quantised(counts: np.ndarray) -> np.ndarray:
    """Levels of counts by powers of two: 1 for 1, 2 for 2 and 3, 3 for 4 to 7, and so on."""
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64)


def expected(levels: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level; 0 for none."""
    levels = levels.astype(np.float64)
    return np.where(levels > 0, (1.5 * np.exp2(levels) - 1) / 2, 0.0)


def filled(prints: np.ndarray, counts: np.ndarray) -> bytes:
    """A filter in which a fingerprint of level q is entered once for each of the levels 1 to q."""
    levels = quantised(counts)
    bits = max(64, int(levels.sum()) * ENTRY_BITS)
    field = np.zeros(bits, dtype=bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        chosen = prints[levels >= level]
        for probe in range(PROBES):
            field[_place(chosen, level, probe, bits)] = True
    return np.packbits(field).tobytes() + bits.to_bytes(8, "little")


def probed(field: np.ndarray, bits: int, prints: np.ndarray) -> np.ndarray:
    """The level of each fingerprint: the filter is asked for levels 1, 2, ... until it denies one."""
    levels = np.zeros(len(prints), np.int64)
    left = np.arange(len(prints))
    for level in range(1, _MOST_LEVELS):
        for i in range(PROBES):
            if not len(left):
                return levels
            place = _place(prints[left], level, i, bits)
            left = left[field[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1 == 1]
        levels[left] = level
    return levels


def _built(table: pa.Table) -> pa.Table:
    """One segment of the model: exact word counts, sorted by hash, and the filter of its pairs."""
    rows = table.to_pylist()
    words_, counts = _summed([(np.frombuffer(r["words"], np.uint64), _unpacked(r["word_counts"]) if r["words"] else np.zeros(0, np.int64)) for r in rows])
    grams, gram_counts = _summed([(_of_prints(r["grams"]), _unpacked(r["gram_counts"]) if r["grams"] else np.zeros(0, np.int64)) for r in rows])
    row = [rows[0]["segment"], len(words_), int(counts.sum()), words_.tobytes(), _packed(counts), filled(grams, gram_counts)]
    kinds = [pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 3]
    names = ["segment", "n_words", "n_seen", "words", "word_counts", "filter"]
    return pa.table({n: pa.array([v], k) for n, v, k in zip(names, row, kinds, strict=True)})


def _asked(segments: int):
    """Questions of a block to the segments: its words, and fingerprints of its distinct pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _one_by_one(batch):
                block = _Block(row)
                grams = np.unique(block.grams)
                rows: dict[int, list[bytes]] = {}
                for segment, a, b in _cuts(block.vocabulary, segments):
                    rows.setdefault(segment, [b"", b""])[0] = block.vocabulary[a:b].tobytes()
                for segment, a, b in _cuts(grams, segments):
                    rows.setdefault(segment, [b"", b""])[1] = _prints(grams[a:b])
                n = len(rows)
                columns = [pa.array(list(rows), pa.int64()), pa.array([row["block"]] * n, pa.int64())]
                columns += [pa.array([r[i] for r in rows.values()], pa.binary()) for i in range(2)]
                columns += [pa.array([None] * n, pa.binary())] * 2
                names = ["segment", "block", "words", "grams", "word_counts", "filter"]
                yield from pa.table(columns, names=names).to_batches(max_chunksize=1000)

    return run


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of segment, the segment of the model before the questions to it."""
    segment, words_, counts, field, bits = None, None, None, None, 64
    for batch in batches:
        out = {name: [] for name in ("block", "segment", "word_counts", "levels")}
        for row in _one_by_one(batch):
            if row["segment"] != segment:
                segment = row["segment"]
                words_, counts, field, bits = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(8, np.uint8), 64
            if row["block"] is None:
                words_, counts = np.frombuffer(row["words"], np.uint64), _unpacked(row["word_counts"])
                field, bits = np.frombuffer(row["filter"], np.uint8), int.from_bytes(row["filter"][-8:], "little")
                continue
            wanted = np.frombuffer(row["words"], np.uint64)
            found = np.zeros(len(wanted), np.int64)
            if len(words_):
                at = np.minimum(np.searchsorted(words_, wanted), len(words_) - 1)
                found = np.where(words_[at] == wanted, counts[at], 0)
            out["block"].append(row["block"])
            out["segment"].append(segment)
            out["word_counts"].append(_packed(found))
            out["levels"].append(probed(field, bits, _of_prints(row["grams"])).astype(np.uint8).tobytes())
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))


def _scored(seen: int, known: int, prior: float):
    """Scores of a block's texts from the answers of all segments."""

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        block = _Block(blocks.slice(0, 1).to_pylist()[0])
        rows = answers.sort_by("segment").to_pylist()
        counts = np.concatenate([_unpacked(r["word_counts"]) for r in rows]).astype(np.float64)
        grams, at = np.unique(block.grams, return_inverse=True)
        levels = np.concatenate([np.frombuffer(r["levels"], np.uint8) for r in rows])
        own, history = counts[block.tokens], counts[block.before]
        # a pair is not seen more often than its words, so a filter's false answer can't raise it beyond them
        pairs = np.minimum(expected(levels)[at], np.minimum(own, history))
        base = (own + 1) / (seen + known + 1)
        model = (pairs + prior * base) / (history + prior)
        first = np.concatenate([[0], block.ends[:-1]])
        return pa.table(
            {
                "doc_id": pa.array(blocks["ids"][0].as_py(), pa.int64()),
                "held_out": pa.array(block.held_out),
                "n_tokens": pa.array(block.ends - first, pa.int64()),
                "n_known": pa.array(np.add.reduceat((own > 0).astype(np.int64), first), pa.int64()),
                "train_tokens": pa.array(np.full(len(first), seen), pa.int64()),
                "base_score": pa.array(np.add.reduceat(np.log10(base), first)),
                "score": pa.array(np.add.reduceat(np.log10(model), first)),
            }
        )

    return run


def encode_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of about ``BLOCK_BYTES`` of text as numbers of words, checkpointed.  ``docs`` has doc_id, text and held_out."""
    return durable(docs.select("doc_id", "text", "held_out").mapInArrow(_encoded, _BLOCK))


def train_model(blocks: DataFrame) -> tuple[DataFrame, int]:
    """The model of the texts that are not held out, as rows of its segments, and the number of segments.

    A segment holds about ``SEGMENT_TOKENS`` tokens' worth of n-grams, so the number of segments grows with the
    tokens, and the size of one doesn't.
    """
    tokens = blocks.agg(F.sum("n_tokens")).first()[0] or 0
    segments = -(-max(tokens, 1) // SEGMENT_TOKENS)
    with _few_rows(blocks.sparkSession, 8):
        counted = blocks.mapInArrow(_trained(segments), _COUNTS)
        return durable(counted.groupBy("segment").applyInArrow(_built, _MODEL)), segments


def score_blocks(blocks: DataFrame, model: DataFrame, segments: int, prior: float = PRIOR) -> DataFrame:
    """A score per text of the blocks by the model."""
    seen, known = model.agg(F.coalesce(F.sum("n_seen"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    columns = ["segment", "block", "words", "grams", "word_counts", "filter"]
    nothing = F.lit(None).cast("binary")
    held = model.select("segment", F.lit(None).cast("bigint").alias("block"), "words", nothing.alias("grams"), "word_counts", "filter")
    schema = "segment bigint, block bigint, words binary, grams binary, word_counts binary, filter binary"
    with _few_rows(blocks.sparkSession, 8):
        # eager, so that no later step holds texts and questions on disk at once
        asked = blocks.mapInArrow(_asked(segments), schema).select(*columns).unionByName(held)
        dealt = asked.repartition("segment").sortWithinPartitions("segment", F.col("block").asc_nulls_first())
        answers = durable(dealt.mapInArrow(_answered, _ANSWERS))
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scored(seen, known, prior), _SCORES)


def language_scores(docs: DataFrame, held_out: Column, prior: float = PRIOR) -> DataFrame:
    """Scores of every text by the words and pairs of the texts where the column ``held_out`` is not true.

    Tokens are words (lower-case A-Z, between white space) and one end.  ``base_score`` adds log10((c + 1) / (N + V + 1)) with
    exact counts of words; ``score`` adds log10 of (e + prior * base) / (c(h) + prior), where h is the word before (the
    end, before the first), and e the count of the pair, as the filter knows it, at most the counts of its words.

    *Log-frequency Bloom filter*: a pair of count c is entered for the levels 1 to 1 + floor(log2 c), and found by
    asking for one level after another until the filter denies one.  With ``ENTRY_BITS`` bits for an entry and
    ``PROBES`` probes, a pair never seen passes level 1 with a chance of 0.3%.  The filter of all pairs has no
    bound on its size, so it isn't one broadcast value: it is cut by hash into segments of bounded size, each
    sent to one place, where the questions of all blocks to it stream past; a question is 40 bits of a pair that
    is in a block of text, and its answer a byte.  All figures grow in proportion to the tokens.

    Pairs and words are told apart by hashes (64 bits for words, 40 within a segment for pairs).  A null or empty text is
    its end alone.  A null id counts as ``held_out`` says, null as not held out; repeated rows count each.  Without
    training texts N and V are 0 and all scores 0.  No rows give no rows.  Further columns are not read.
    """
    rows = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    blocks = encode_blocks(rows)
    return score_blocks(blocks, *train_model(blocks), prior=prior)


def language_model_query(documents: DataFrame) -> DataFrame:
    return language_scores(documents, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
