"""How the sources of a language differ in the terms they use, from exact counts of every kept term."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetvitals.llm.text import Texts, mix64, slices, text_bytes
from fleetvitals.plans import durable

SCALE = 1_000_000_000
LEAST_DOCS = 3
TOP = 200
# Text counted at once, runs held before they are merged, and text per bucket of terms.  Counting takes about 40 bytes
# of memory for a byte of text, merging about 100 bytes for a run, in every task of an executor.
CHUNK_BYTES = 2 << 20
HELD_RUNS = 1_000_000
BUCKET_BYTES = 4 << 20
# Terms times sources worked on at once.
CELLS = 500_000

# letters, and every byte of a character outside ASCII
_TERM = np.zeros(256, dtype=bool)
_TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_RUNS = "lang string, bucket bigint, width int, sources array<string>, at binary, terms binary, counts binary, docs binary"
_KEPT = "lang string, bucket bigint, width int, sources array<string>, sizes array<bigint>, n_terms bigint, at binary, terms binary, counts binary"
_FOUND = "lang string, source string, part string, item string, value bigint"


def _order(keys: list[np.ndarray]) -> np.ndarray:
    """The order of rows by keys, the last one first: numbers by radix passes over 16 bits, bytes by a stable sort."""
    order = np.arange(len(keys[0]))
    for key in keys:
        if key.dtype.kind == "S":
            order = order[np.argsort(key[order], kind="stable")]
            continue
        for shift in range(0, key.dtype.itemsize * 8, 16):
            digit = (key >> key.dtype.type(shift)).astype(np.uint16)
            if digit.size and (digit != digit[0]).any():
                # numpy sorts 16-bit numbers by radix
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _words(terms: np.ndarray) -> list[np.ndarray]:
    """Sort keys of packed terms: one or two words, or the bytes."""
    return [terms] if terms.ndim == 1 else [terms[:, 1], terms[:, 0]]


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for column in columns:
        new[1:] |= column[1:] != column[:-1]
    return new


class Runs:
    """Counted terms of one width: group, packed term, occurrences and documents."""

    def __init__(self, at: np.ndarray, terms: np.ndarray, counts: np.ndarray, docs: np.ndarray):
        self.at, self.terms, self.counts, self.docs = at, terms, counts, docs

    def __len__(self) -> int:
        return len(self.at)

    @staticmethod
    def merged(parts: list[Runs]) -> Runs:
        """One run for each term and group, in order of term, then group."""
        at, terms, counts, docs = (np.concatenate([getattr(p, n) for p in parts]) for n in ("at", "terms", "counts", "docs"))
        if not len(at):
            return Runs(at, terms, counts, docs)
        order = _order([at, *_words(terms)])
        at, terms = at[order], terms[order]
        first = np.flatnonzero(_changes(at, *_words(terms)))
        return Runs(at[first], terms[first], np.add.reduceat(counts[order], first), np.add.reduceat(docs[order], first))


def _width(lengths: np.ndarray) -> np.ndarray:
    """Bytes a term is packed into: 8 or 16 (words), beyond that multiples of 8 up to 64, then powers of two."""
    small = np.maximum((lengths + 7) // 8 * 8, 8)
    return np.where(lengths <= 64, small, 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64))


def _packed(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """Terms of one width, padded with zeros: words in byte order, so numbers sort as bytes do, or byte strings."""
    held = np.concatenate([data, np.zeros(width, np.uint8)])
    if width <= 16:
        windows = np.lib.stride_tricks.sliding_window_view(held, 8)
        out = np.empty((len(starts), width // 8), dtype=np.uint64)
        for i in range(width // 8):
            word = np.ascontiguousarray(windows[starts + 8 * i]).view(">u8")[:, 0].astype(np.uint64)
            room = np.clip(8 * (i + 1) - lengths, 0, 7).astype(np.uint64) * np.uint64(8)
            out[:, i] = word >> room << room
        return out[:, 0] if width == 8 else out
    cells = np.lib.stride_tricks.sliding_window_view(held, width)[starts]
    cells[np.arange(width) >= lengths[:, None]] = 0
    return np.ascontiguousarray(cells).view(f"S{width}")[:, 0]


def count_terms(texts: Texts, groups: np.ndarray) -> dict[int, Runs]:
    """Runs by width of some texts, whose groups are given; terms are lower-case (A-Z) runs of term bytes."""
    data, bounds = _LOWER[texts.data], texts.bounds
    if not len(data):
        return {}
    inside = _TERM[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    first[inner] |= inside[inner]
    last[inner - 1] |= inside[inner - 1]
    starts = np.flatnonzero(first)
    lengths = np.flatnonzero(last) + 1 - starts
    # documents are numbered by group, so terms in order of document are in order of group
    by_group = np.argsort(groups, kind="stable")
    number = np.empty(len(groups), dtype=np.uint32)
    number[by_group] = np.arange(len(groups), dtype=np.uint32)
    doc = number[np.searchsorted(bounds, starts, side="right") - 1]
    out, widths = {}, _width(lengths)
    for width in np.unique(widths).tolist():
        chosen = np.flatnonzero(widths == width)
        terms, of = _packed(data, starts[chosen], lengths[chosen], width), doc[chosen]
        order = _order([of, *_words(terms)])
        terms, of = terms[order], of[order]
        at = groups[by_group][of]
        new_doc, new = _changes(of, *_words(terms)), np.flatnonzero(_changes(at, *_words(terms)))
        counts = np.diff(np.append(new, len(of))).astype(np.int64)
        out[width] = Runs(at[new], terms[new], counts, np.add.reduceat(new_doc.astype(np.int64), new))
    return out


class _Held:
    """Runs by width, merged whenever many have come together."""

    def __init__(self):
        self.parts: dict[int, list[Runs]] = {}
        self.rows, self.limit = 0, HELD_RUNS

    def add(self, found: dict[int, Runs]) -> None:
        for width, runs in found.items():
            self.parts.setdefault(width, []).append(runs)
            self.rows += len(runs)
        if self.rows > self.limit:
            self.merge()
            self.limit = max(HELD_RUNS, 2 * self.rows)

    def merge(self) -> dict[int, Runs]:
        merged = {width: Runs.merged(parts) for width, parts in self.parts.items()}
        self.parts = {width: [runs] for width, runs in merged.items()}
        self.rows = sum(map(len, merged.values()))
        return merged


def _bucket(terms: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket by the term alone, from all its words."""
    if terms.dtype.kind == "S":
        words = np.ascontiguousarray(terms).view(np.uint64).reshape(len(terms), -1)
    else:
        words = terms.reshape(len(terms), -1)
    mixed = np.zeros(len(terms), np.uint64)
    for i in range(words.shape[1]):
        mixed = mix64(mixed + words[:, i] + np.uint64(i + 1))
    return (mixed % np.uint64(buckets)).astype(np.int64)


def _emitted(runs: dict[int, Runs], groups: list[tuple[str, str]], buckets: int) -> Iterator[pa.RecordBatch]:
    """Runs as rows of (language, bucket, width), each with arrays of the terms in it."""
    number: dict[str, int] = {}
    lang_of = np.array([number.setdefault(lang, len(number)) for lang, _ in groups], dtype=np.int64)
    langs = list(number)
    for width, r in runs.items():
        if not len(r):
            continue
        key = lang_of[r.at] * buckets + _bucket(r.terms, buckets)
        order = np.argsort(key, kind="stable")
        cuts = np.append(np.flatnonzero(_changes(key[order])), len(order))
        rows = {name: [] for name in ("lang", "bucket", "width", "sources", "at", "terms", "counts", "docs")}
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            chosen = order[a:b]
            used, at = np.unique(r.at[chosen], return_inverse=True)
            rows["lang"].append(langs[int(key[chosen[0]]) // buckets])
            rows["bucket"].append(int(key[chosen[0]]) % buckets)
            rows["width"].append(width)
            rows["sources"].append([groups[g][1] for g in used])
            rows["at"].append(at.astype(np.uint32).tobytes())
            for name in ("terms", "counts", "docs"):
                rows[name].append(np.ascontiguousarray(getattr(r, name)[chosen]).tobytes())
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.list_(pa.string()), *[pa.binary()] * 4]
        table = pa.table({n: pa.array(v, k) for (n, v), k in zip(rows.items(), kinds, strict=True)})
        yield from table.to_batches(max_chunksize=1000)


def _counted(buckets: int):
    """Terms of a task's documents, counted by (language, source) before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], int] = {}
        held = _Held()
        for batch in batches:
            table = pa.Table.from_batches([batch])
            pairs = zip(table["lang"].fill_null("").to_pylist(), table["source"].fill_null("").to_pylist(), strict=True)
            at = np.array([groups.setdefault(pair, len(groups)) for pair in pairs], dtype=np.uint32)
            for first, end, some in slices(text_bytes(table["text"]), CHUNK_BYTES):
                held.add(count_terms(some, at[first:end]))
                if held.limit > HELD_RUNS:
                    yield from _emitted(held.merge(), list(groups), buckets)
                    held = _Held()
        yield from _emitted(held.merge(), list(groups), buckets)

    return run


def _one_by_one(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, made one at a time, as each holds large arrays."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _unpacked(width: int, blob: bytes) -> np.ndarray:
    if width > 16:
        return np.frombuffer(blob, dtype=f"S{width}")
    words = np.frombuffer(blob, dtype=np.uint64)
    return words if width == 8 else words.reshape(-1, 2)


def _kept_rows(lang: str, bucket: int, sources: list[str], held: _Held, least: int) -> Iterator[pa.RecordBatch]:
    """The terms of a bucket that are in enough documents of the language."""
    rows = {name: [] for name in ("lang", "bucket", "width", "sources", "sizes", "n_terms", "at", "terms", "counts")}
    for width, runs in held.merge().items():
        if not len(runs):
            continue
        first = np.flatnonzero(_changes(*_words(runs.terms)))
        spans = np.diff(np.append(first, len(runs)))
        enough = np.add.reduceat(runs.docs, first) >= least
        chosen = np.repeat(enough, spans)
        if not enough.any():
            continue
        at, counts = runs.at[chosen], runs.counts[chosen]
        sizes = np.zeros(len(sources), np.int64)
        np.add.at(sizes, at, counts)
        values = (lang, bucket, width, sources, sizes, int(enough.sum()), at.tobytes(), np.ascontiguousarray(runs.terms[chosen]).tobytes(), counts.tobytes())
        for name, value in zip(rows, values, strict=True):
            rows[name].append(value)
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.int64(), *[pa.binary()] * 3]
    if rows["lang"]:
        yield from pa.table({n: pa.array(v, k) for (n, v), k in zip(rows.items(), kinds, strict=True)}).to_batches()


def _merged(least: int):
    """Rows in order of (language, bucket), merged one bucket at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, names, held = None, {}, _Held()
        for batch in batches:
            for row in _one_by_one(batch):
                if (row["lang"], row["bucket"]) != place:
                    if place is not None:
                        yield from _kept_rows(*place, list(names), held, least)
                    place, names, held = (row["lang"], row["bucket"]), {}, _Held()
                here = np.array([names.setdefault(s, len(names)) for s in row["sources"]], dtype=np.uint32)
                at = here[np.frombuffer(row["at"], dtype=np.uint32)]
                counts, docs = (np.frombuffer(row[n], dtype=np.int64) for n in ("counts", "docs"))
                held.add({row["width"]: Runs(at, _unpacked(row["width"], row["terms"]), counts, docs)})
        if place is not None:
            yield from _kept_rows(*place, list(names), held, least)

    return run


def shares(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(10 ** 9 * counts / total) in whole numbers, three decimals at a time (total below 9 * 10 ** 15)."""
    out, rest = counts // total, counts % total
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out + 1


def _item(width: int, term) -> bytes:
    """The bytes of a packed term."""
    if width > 16:
        return bytes(term)
    return np.atleast_1d(term).astype(">u8").tobytes().rstrip(b"\0")


def _compared(top: int):
    """Divergences of one bucket's terms: sums for every pair of sources, and the strongest terms of each source."""

    def pairs(p: np.ndarray) -> np.ndarray:
        out = np.zeros((len(p), len(p)), np.int64)
        for a in range(len(p)):
            d = p[a] - p
            out[a] = (d * d // p).sum(axis=1)
        return out

    def strongest(f: np.ndarray, over: np.ndarray, width: int, terms: np.ndarray) -> list[tuple[bytes, int]]:
        where = np.flatnonzero(over)
        if len(where) > top:
            least = np.partition(f[where], len(where) - top)[len(where) - top]
            where = where[f[where] >= least]
        return sorted(((_item(width, terms[i]), int(f[i])) for i in where), key=lambda x: (-x[1], x[0]))[:top]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _one_by_one(batch):
                names = row["all_sources"]
                total = np.array(row["all_sizes"], np.int64)[:, None] + row["vocabulary"]
                sums = np.zeros((len(names), len(names)), np.int64)
                found = []
                if row["terms"]:
                    width, terms = row["width"], _unpacked(row["width"], row["terms"])
                    place = {name: i for i, name in enumerate(names)}
                    source = np.array([place[s] for s in row["sources"]])[np.frombuffer(row["at"], np.uint32)]
                    counts = np.frombuffer(row["counts"], np.int64)
                    new = _changes(*_words(terms))
                    number, terms = np.cumsum(new) - 1, terms[np.flatnonzero(new)]
                    step = max(1, CELLS // len(names))
                    strong: list[list[tuple[bytes, int]]] = [[] for _ in names]
                    for a in range(0, len(terms), step):
                        b = min(a + step, len(terms))
                        lo, hi = np.searchsorted(number, [a, b])
                        c = np.zeros((len(names), b - a), np.int64)
                        c[source[lo:hi], number[lo:hi] - a] = counts[lo:hi]
                        p, q = shares(c + 1, total), shares(c.sum(axis=0) + 1, row["lang_size"] + row["vocabulary"])
                        sums += pairs(p)
                        d = p - q
                        f, over = d * d // q, (c > 0) & (d > 0)
                        for s in range(len(names)):
                            strong[s] = sorted(strong[s] + strongest(f[s], over[s], width, terms[a:b]), key=lambda x: (-x[1], x[0]))[:top]
                    found = [(names[s], "term", item.decode(), value) for s, items in enumerate(strong) for item, value in items]
                for a, name in enumerate(names):
                    found += [(name, "pair", names[b], value) for b, value in enumerate(sums[a].tolist()) if b != a]
                    if len(found) > 50_000:
                        yield _rows(row["lang"], found)
                        found = []
                yield _rows(row["lang"], found)

    return run


def _rows(lang: str, found: list[tuple[str, str, str, int]]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) if found else [[], [], [], []]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64()]
    arrays = [pa.array([lang] * len(found), pa.string()), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))]
    return pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "part", "item", "value"])


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: how the sources of a language differ in their terms.

    Terms are runs of letters and characters outside ASCII, A-Z in lower case; a language keeps those in at least
    ``least_docs`` of its documents.  A group's share of a term is p = 1 + floor(10^9 (count + 1) / (N + V)), N its kept
    occurrences and V the language's kept terms; the divergence of p from q is floor((p - q)^2 / q).  Part ``pair`` adds it up
    over all kept terms for every other source of the language; part ``term`` gives the ``top`` terms whose share
    exceeds the language's.  All numbers are whole; ranks order by value, then by the item's UTF-8 bytes.

    *Length-bucketed packing*: a term of up to 8 or 16 bytes becomes one or two 64-bit words, which are radix-sorted by
    (term, document) and counted as runs in numpy; longer terms are sorted as bytes, in buckets by padded length.  A
    task merges its runs before it emits them, as arrays by language and hash bucket of the term.  A bucket holds the
    terms of about ``BUCKET_BYTES`` of text, so there are more of them for larger tables; it is merged while it streams
    in, so a term that is everywhere costs one run per source, and no list of all its places.  Sums over terms
    are made a bucket at a time over a matrix of ``CELLS`` counts, and added up by Spark.

    Null text, language or source count as empty text.  A group without terms, or a language without kept terms (all
    values 0), has its pairs; a language's only source has none.  Repeated rows count each.  No rows give no rows.
    Further columns are not read.
    """
    whole = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    groups = durable(whole.groupBy("lang", "source").agg(F.sum(F.octet_length("text")).alias("_bytes")))
    buckets = -(-(groups.agg(F.sum("_bytes")).first()[0] or 1) // BUCKET_BYTES)
    counted = whole.mapInArrow(_counted(buckets), _RUNS)
    dealt = counted.repartition("lang", "bucket").sortWithinPartitions("lang", "bucket")
    kept = durable(dealt.mapInArrow(_merged(least_docs), _KEPT))
    sizes = kept.select("lang", F.explode(F.arrays_zip("sources", "sizes")).alias("_s")).groupBy("lang", F.col("_s.sources").alias("source"))
    known = groups.join(sizes.agg(F.sum("_s.sizes").alias("_size")), ["lang", "source"], "left").withColumn("_size", F.coalesce("_size", F.lit(0)))
    vocabulary = kept.groupBy("lang").agg(F.sum("n_terms").alias("_terms"))
    listed = F.sort_array(F.collect_list(F.struct("source", "_size")))
    langs = known.groupBy("lang").agg(listed.alias("_all"), F.sum("_size").alias("lang_size")).join(vocabulary, "lang", "left")
    langs = langs.select(
        "lang", F.col("_all.source").alias("all_sources"), F.col("_all._size").alias("all_sizes"), "lang_size", F.coalesce("_terms", F.lit(0)).alias("vocabulary")
    )
    met = langs.join(kept.select("lang", "width", "sources", "at", "terms", "counts"), "lang", "left")
    found = durable(met.mapInArrow(_compared(top), _FOUND))
    summed = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    columns = ["lang", "source", "part", "item", "value"]
    pairs = summed.select(*columns, rank.alias("rank"))
    terms = found.where("part = 'term'").select(*columns, rank.alias("rank")).where(F.col("rank") <= top)
    return pairs.unionByName(terms)


def divergence_query(documents: DataFrame) -> DataFrame:
    return source_divergence(documents)


DIVERGENCE_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
terms AS (
  SELECT r, lang, source, translate(term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs)),
kept AS (SELECT lang, term, count(*) AS c FROM terms GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
groups AS (SELECT DISTINCT lang, source FROM docs),
v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
counts AS (SELECT t.lang, t.source, t.term, count(*) AS c FROM terms t JOIN kept USING (lang, term) GROUP BY ALL),
n AS (SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM groups g LEFT JOIN counts c USING (lang, source) GROUP BY ALL),
cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
         (1 + 1000000000::HUGEINT * (coalesce(c.c, 0) + 1) // (n.n + v.v))::HUGEINT AS p, (1 + 1000000000::HUGEINT * (k.c + 1) // (v.n + v.v))::HUGEINT AS q
  FROM groups g JOIN kept k USING (lang) JOIN v USING (lang) JOIN n USING (lang, source) LEFT JOIN counts c USING (lang, source, term)),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
  FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL
  SELECT a.lang, a.source, 'pair', b.source, 0 FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  WHERE a.lang NOT IN (SELECT lang FROM v)),
found AS (
  SELECT * FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM cells WHERE c > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found)
WHERE part = 'pair' OR rank <= 200
"""
