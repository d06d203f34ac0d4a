"""Removal of long strings that an earlier document has: suffix buckets sorted one at a time, with a difference cover.

Positions of a text whose number modulo PERIOD is in COVER are its cover sample.  Any two positions have an equal
offset below PERIOD at which both are in the sample, so two equal strings of LENGTH bytes hold, at the same offset, two
sample positions that begin with the same PREFIX = LENGTH - PERIOD + 1 bytes.  The suffixes of a string are therefore
compared by the few bytes up to such an offset and the rank of the sample suffix there, and only sample suffixes
are ever sorted: a bucket of them at a time, those that share their first bytes with another document's.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetvitals.llm import text
from fleetvitals.plans import durable

LENGTH = 50
# A perfect difference set; every remainder modulo 31 is the difference of two of its members.
PERIOD = 31
COVER = (0, 1, 3, 8, 12, 18)
PREFIX = LENGTH - PERIOD + 1
BEFORE = PERIOD - 1

# Bytes of text in a chunk, and sample positions in a bucket of prefixes and in one of suffixes, about.
CHUNK_BYTES = 4 << 20
PREFIX_BUCKET = 3_000_000
SUFFIX_BUCKETS = 2

NULL_ID = (1 << 63) - 1
_COPY, _FLAGS, _STARTS = 0, 1, 2
_SIDE = "chunk int, kind int, id bigint, n int, data binary"
_RECORD = np.dtype([("id", "<i8"), ("row", "<i4"), ("at", "<i4"), ("left", "u1"), ("right", "u1")])
_START = np.dtype([("row", "<i4"), ("at", "<i4"), ("mask", "<i4")])


def _pack(data: np.ndarray) -> bytes:
    """Compressed, with the first bytes of all records together, then the second ones."""
    width = data.dtype.itemsize
    return zstandard.compress(data.view(np.uint8).reshape(-1, width).T.tobytes() if len(data) else b"", 1)


def _unpack(data: bytes, dtype: np.dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(dtype.itemsize, -1).T).view(dtype).ravel()


def _side(chunk: list, kind: int, ids: list, n: list, data: list) -> pa.Table:
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
    columns = [pa.array(c, t) for c, t in zip((chunk, [kind] * len(chunk), ids, n, data), types, strict=True)]
    return pa.Table.from_arrays(columns, ["chunk", "kind", "id", "n", "data"])


def _of(side: pa.Table, kind: int) -> pa.Table:
    """Side rows of a kind; a chunk without any comes as a table without columns."""
    return side.filter(pa.compute.equal(side["kind"], kind)) if side.num_rows else _side([], kind, [], [], [])


class Chunk:
    """Texts of a chunk in a fixed order; later copies of a text are empty here, as nothing of them is in doubt."""

    def __init__(self, rows: pa.Table, side: pa.Table):
        rows = rows.combine_chunks().sort_by([("id", "ascending"), ("sha", "ascending")])
        copies = _of(side, _COPY)
        known = set(zip(copies["id"].to_pylist(), copies["data"].to_pylist(), strict=True))
        self.ids, self.shas = rows["id"].to_numpy(), rows["sha"].to_pylist()
        self.copy = np.array([pair in known for pair in zip(self.ids.tolist(), self.shas, strict=True)], dtype=bool)
        self.texts = text.text_bytes(rows["body"])

    def samples(self):
        """For slices of the texts: first row, the texts, and of each cover position its row, place and prefix hash."""
        for first, end, some in text.slices(self.texts):
            size = np.diff(some.bounds)
            owner = np.repeat(np.arange(len(some)), size)
            place = np.arange(len(some.data)) - some.bounds[:-1][owner]
            residues = np.zeros(PERIOD, dtype=bool)
            residues[list(COVER)] = True
            room = np.where(self.copy[first:end] | (size < LENGTH), 0, size)[owner]
            at = np.flatnonzero(residues[place % PERIOD] & (place + PREFIX <= room))
            up, down = text.powers(len(some.data))
            sums = np.zeros(len(some.data) + 1, dtype=np.uint64)
            np.cumsum(text._BYTE[some.data] * up[: len(some.data)], out=sums[1:])
            names = text.mix64((sums[at + PREFIX] - sums[at]) * down[at])
            yield first, some, owner[at], at, place[at], names


def _prefix_keys(names: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a prefix in the high half, 32 bits of its hash in the low one."""
    return (names % np.uint64(buckets)) << np.uint64(32) | names >> np.uint64(32)


def _prefixes(buckets: int):
    """Distinct prefixes of a chunk by bucket, and which of them several of its rows have."""

    def run(key: tuple, rows: pa.Table, side: pa.Table) -> pa.Table:
        columns = [[], [], [], [], []]
        if rows.num_rows:
            chunk, found = Chunk(rows, side), []
            for first, _, row, _, _, names in chunk.samples():
                keys = _prefix_keys(names, buckets)
                order = np.lexsort((row, keys))
                k, r = keys[order], row[order]
                new = np.ones(len(k), dtype=bool)
                new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
                found.append(k[new])
            keys, counts = np.unique(np.concatenate(found), return_counts=True)
            bounds = np.searchsorted(keys, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))
            for bucket in np.flatnonzero(np.diff(bounds)):
                a, b = bounds[bucket], bounds[bucket + 1]
                values = keys[a:b].astype(np.uint32)
                packed = _pack(np.diff(values, prepend=np.uint32(0)))
                for column, value in zip(columns, (bucket, key[0].as_py(), b - a, packed, np.packbits(counts[a:b] > 1).tobytes()), strict=True):
                    column.append(value)
        types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["bucket", "chunk", "n", "values", "several"])

    return run


def _repeated(key: tuple, rows: pa.Table) -> pa.Table:
    """For each chunk the prefixes of this bucket that another row has too, as bits in the chunk's order."""
    sizes = rows["n"].to_numpy()
    values = [np.cumsum(_unpack(v, np.dtype("<u4")), dtype=np.uint32) for v in rows["values"].to_pylist()]
    several = [np.unpackbits(np.frombuffer(s, np.uint8), count=n).astype(bool) for s, n in zip(rows["several"].to_pylist(), sizes, strict=True)]
    everything = np.sort(np.concatenate(values))
    shared = np.unique(everything[1:][everything[1:] == everything[:-1]])
    del everything
    flags = []
    for own, many in zip(values, several, strict=True):
        at = np.minimum(np.searchsorted(shared, own), max(len(shared) - 1, 0))
        flags.append(np.packbits(many | (shared[at] == own if len(shared) else False)).tobytes())
    return _side(rows["chunk"].to_pylist(), _FLAGS, [key[0].as_py()] * rows.num_rows, sizes.tolist(), flags)


def _suffixes(buckets: int, suffix_buckets: int):
    """Sample suffixes of a chunk whose prefix is repeated, with the bytes before them, by bucket of the prefix."""

    def run(key: tuple, rows: pa.Table, side: pa.Table) -> pa.Table:
        columns = [[], [], [], []]
        marks = _of(side, _FLAGS)
        if rows.num_rows and marks.num_rows:
            chunk = Chunk(rows, side)
            made = list(chunk.samples())
            keys = [_prefix_keys(names, buckets) for *_, names in made]
            distinct = np.unique(np.concatenate(keys))
            order = np.argsort(marks["id"].to_numpy(), kind="stable")
            bits, sizes = marks["data"].to_pylist(), marks["n"].to_pylist()
            flags = np.concatenate([np.unpackbits(np.frombuffer(bits[i], np.uint8), count=sizes[i]) for i in order]).astype(bool)
            found = []
            for (first, some, row, at, place, names), own in zip(made, keys, strict=True):
                hit = flags[np.searchsorted(distinct, own)]
                row, at, place = row[hit], at[hit], place[hit]
                records = np.zeros(len(at), dtype=_RECORD)
                records["id"], records["row"], records["at"] = chunk.ids[first + row], first + row, place
                records["left"] = np.minimum(place, BEFORE)
                records["right"] = np.minimum(some.bounds[row + 1] - at, LENGTH)
                spread = at[:, None] + np.arange(-BEFORE, LENGTH)
                found.append((names[hit], records, some.data[np.clip(spread, 0, max(len(some.data) - 1, 0))]))
            names, records, context = (np.concatenate(column) for column in zip(*found, strict=True))
            bucket = (names % np.uint64(suffix_buckets)).astype(np.int64)
            order = np.lexsort((names, bucket))
            records, context, bucket = records[order], context[order], bucket[order]
            bounds = np.searchsorted(bucket, np.arange(suffix_buckets + 1))
            for b in np.flatnonzero(np.diff(bounds)):
                part = slice(bounds[b], bounds[b + 1])
                # texts have most in common row by row
                rowwise = zstandard.compress(context[part].tobytes(), 3)
                for column, value in zip(columns, (b, key[0].as_py(), _pack(records[part]), rowwise), strict=True):
                    column.append(value)
        types = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["bucket", "chunk", "data", "context"])

    return run


def _sorted_common(data: np.ndarray, names: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte rows, under their names if given, and how many first bytes each shares with the one before it."""
    width = -(-data.shape[1] // 8)
    padded = np.zeros((len(data), width * 8), dtype=np.uint8)
    padded[:, : data.shape[1]] = data
    parts = padded.view(">u8").astype(np.uint64)
    order = np.lexsort(parts.T[::-1] if names is None else (*parts.T[::-1], names))
    rows = data[order]
    other = rows[1:] != rows[:-1]
    common = np.full(len(data), -1, dtype=np.int64)
    common[1:] = np.where(other.any(axis=1), other.argmax(axis=1), data.shape[1])
    if names is not None:
        common[1:][names[order][1:] != names[order][:-1]] = -1
    return order, common


def covered_starts(records: np.ndarray, context: np.ndarray) -> np.ndarray:
    """For each sample suffix the bit d set if the string of LENGTH bytes d before it also starts in a smaller id.

    The suffixes are sorted by what follows and by what precedes them (read backwards).  The strings that start d
    bytes before two of them are equal if they share LENGTH - d bytes forwards and d bytes backwards, so the ranks in
    both orders, cut where neighbours share less, name the strings; the least id of a name decides.
    """
    mask = np.zeros(len(records), dtype=np.int32)
    forwards, ahead = _sorted_common(context[:, BEFORE:])
    prefix = np.empty(len(records), np.int64)
    prefix[forwards] = np.cumsum(ahead < PREFIX)
    backwards, behind = _sorted_common(context[:, :BEFORE][:, ::-1], prefix)
    ids, left, right = records["id"], records["left"], records["right"]
    after, before = np.empty(len(records), np.int64), np.empty(len(records), np.int64)
    for d in range(PERIOD):
        after[forwards] = np.cumsum(ahead < LENGTH - d)
        before[backwards] = np.cumsum(behind < d)
        whole = np.flatnonzero((left >= d) & (right >= LENGTH - d))
        whole = whole[np.bincount(after[whole], minlength=len(records) + 1)[after[whole]] > 1]
        if not len(whole):
            continue
        names = after[whole] * (len(records) + 1) + before[whole]
        order = np.lexsort((ids[whole], names))
        names, at = names[order], whole[order]
        new = np.ones(len(names), dtype=bool)
        new[1:] = names[1:] != names[:-1]
        least = ids[at][np.flatnonzero(new)][np.cumsum(new) - 1]
        mask[at[ids[at] > least]] |= np.int32(1 << d)
    return mask


def _ranked(key: tuple, rows: pa.Table) -> pa.Table:
    """Starts of repeated strings that one bucket of suffixes shows, by chunk."""
    parts = [_unpack(data, _RECORD) for data in rows["data"].to_pylist()]
    chunk = np.repeat(rows["chunk"].to_numpy(), [len(p) for p in parts])
    records = np.concatenate(parts)
    del parts
    context = np.frombuffer(b"".join(map(zstandard.decompress, rows["context"].to_pylist())), np.uint8)
    mask = covered_starts(records, context.reshape(-1, BEFORE + LENGTH))
    hit = np.flatnonzero(mask)
    hit = hit[np.argsort(chunk[hit], kind="stable")]
    starts = np.zeros(len(hit), dtype=_START)
    starts["row"], starts["at"], starts["mask"] = records["row"][hit], records["at"][hit], mask[hit]
    chunks, first = np.unique(chunk[hit], return_index=True)
    bounds = np.append(first, len(hit))
    data = [_pack(starts[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return _side(chunks.tolist(), _STARTS, [0] * len(data), np.diff(bounds).tolist(), data)


def _removed(key: tuple, rows: pa.Table, side: pa.Table) -> pa.Table:
    """What is left of each text of a chunk."""
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    if not rows.num_rows:
        return schema.empty_table()
    chunk = Chunk(rows, side)
    texts = chunk.texts
    edges = np.zeros(len(texts.data) + 1, dtype=np.int32)
    for data in _of(side, _STARTS)["data"].to_pylist():
        starts = _unpack(data, _START)
        base = texts.bounds[starts["row"]] + starts["at"]
        for d in range(PERIOD):
            at = base[starts["mask"] >> d & 1 == 1] - d
            np.add.at(edges, at, 1)
            np.add.at(edges, at + LENGTH, -1)
    covered = np.cumsum(edges[:-1]) > 0
    out = [[], [], [], [], []]
    for i, (a, b) in enumerate(zip(texts.bounds[:-1], texts.bounds[1:], strict=True)):
        gone = np.full(b - a, b - a >= LENGTH) if chunk.copy[i] else covered[a:b]
        removed = int(gone.sum())
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        digest = hashlib.sha256(texts.data[a:b][~gone].tobytes()).hexdigest() if removed else chunk.shas[i].hex()
        for column, value in zip(out, (int(chunk.ids[i]), int(b - a), removed, spans, digest), strict=True):
            column.append(value)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` of every row of ``docs``.

    A byte is removed if a string of 50 bytes that covers it also starts in a text with a smaller id; texts are UTF-8
    bytes as given, and strings do not cross them.

    1. Texts equal to one with a smaller id are known whole and take no further part.
    2. Chunks of texts list the hashed prefixes of their cover sample by bucket, each once; a bucket's task tells each
       chunk which of them several texts have.  (Hashes only choose what is looked at.)
    3. Sample suffixes with such a prefix go, with 30 bytes before and 50 after, to the bucket of their prefix, where
       they are sorted, and the repeated strings around them are told to their chunks.
    4. Chunks remove them.

    Texts are shuffled once, by chunk, and that exchange is read three times.  A task holds one chunk or one bucket,
    whose sizes don't grow with the table, but for a text longer than a chunk and a prefix in very many places.

    A null or empty text has 0 bytes.  A null id is larger than every id, and null ids don't cover each other.  Rows
    that repeat an id don't cover each other.  No rows give no rows.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)).alias("id"), body.alias("body"), F.unhex(F.sha2(body, 256)).alias("sha"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = total // CHUNK_BYTES + 1
    buckets = total * len(COVER) // PERIOD // PREFIX_BUCKET + 1
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int"))
    narrow = rows.select("chunk", "id", "sha")
    firsts = narrow.groupBy("sha").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("sha", "first")
    later = narrow.join(firsts, "sha").where("id > first")
    named = {"copy_chunk": "chunk", "copy_kind": F.lit(_COPY), "copy_id": "id", "copy_n": F.lit(0), "copy_data": "sha"}
    # columns of their own, so that a chunk's texts and its copies are told apart
    copies = durable(later.select(*((F.col(c) if isinstance(c, str) else c).alias(name) for name, c in named.items())))
    copies = copies.toDF("chunk", "kind", "id", "n", "data")
    texts = rows.groupBy("chunk")

    def with_texts(side: DataFrame):
        return texts.cogroup(side.groupBy("chunk"))

    prefixes = with_texts(copies).applyInArrow(_prefixes(buckets), "bucket int, chunk int, n int, values binary, several binary")
    flags = prefixes.groupBy("bucket").applyInArrow(_repeated, _SIDE)
    suffixes = with_texts(copies.union(flags)).applyInArrow(_suffixes(buckets, buckets * SUFFIX_BUCKETS), "bucket int, chunk int, data binary, context binary")
    starts = suffixes.groupBy("bucket").applyInArrow(_ranked, _SIDE)
    result = with_texts(copies.union(starts)).applyInArrow(
        _removed, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    )
    return result.select(F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def suffix_query(documents: DataFrame) -> DataFrame:
    return remove_repeats(documents)
