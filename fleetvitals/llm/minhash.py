"""Near-duplicates: MinHash with tensored banding, every link confirmed on the full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetvitals.llm import text
from fleetvitals.llm.graph import components
from fleetvitals.plans import durable

# Two collections of COLLECTION half keys of HALF minhashes; each pair of half keys is a table's key.
COLLECTION = 10
HALF = 3
PERCENT = 80
# Members of a group compared with each other in one step of a task.
BLOCK = 1_000

_SIGNATURE = "_id bigint, n_shingles bigint, f1 bigint, f2 bigint, left array<bigint>, right array<bigint>"


def _signatures(width: int, collection: int, half: int):
    """Sets sizes, fingerprints and half keys of Arrow batches of (_id, _text)."""
    functions = 2 * collection * half
    factors, shifts = text.numbers(3, functions) | np.uint64(1), text.numbers(4, functions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, end, some in text.slices(text.text_bytes(batch.column(1))):
                hashes, bounds = text.distinct(*text.shingles(text.words(some), width))
                sizes = np.diff(bounds)
                filled = np.flatnonzero(sizes)
                at = bounds[:-1][filled]
                keys = np.zeros((len(sizes), 2 * collection), dtype=np.uint64)
                marks = np.zeros((len(sizes), 2), dtype=np.uint64)
                if len(filled):
                    for i in range(functions):
                        least = np.minimum.reduceat(hashes * factors[i] + shifts[i], at)
                        keys[filled, i // half] = text.mix64(keys[filled, i // half] * text._M1 + least + np.uint64(i))
                    for i in range(2):
                        marks[filled, i] = np.add.reduceat(text.mix64(hashes + factors[i]), at)
                columns = [ids.slice(first, end - first), pa.array(sizes), *(pa.array(marks[:, i].view(np.int64)) for i in range(2))]
                for half_keys in (keys[:, :collection], keys[:, collection:]):
                    flat = np.ascontiguousarray(half_keys).view(np.int64).ravel()
                    columns.append(pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, collection, dtype=np.int32), flat))
                yield pa.RecordBatch.from_arrays(columns, ["_id", "n_shingles", "f1", "f2", "left", "right"])

    return run


def _sets(width: int):
    """Sorted distinct shingle hashes of Arrow batches of (_id, _text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, some in text.slices(text.text_bytes(batch.column(1))):
                hashes, bounds = text.distinct(*text.shingles(text.words(some), width))
                lists = pa.ListArray.from_arrays(bounds.astype(np.int32), hashes.view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), lists], ["id", "shingles"])

    return run


def _linked(a: dict, b: dict, collection: int, percent: int, one: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links between two lists of members that share left half key number ``a["i"]``, from their full sets.

    A pair is looked at if it isn't connected yet, its sizes allow the similarity, it shares a right half key, and this
    is the first left half key that it shares.  ``one``: both lists are the same.
    """
    small, large = np.minimum.outer(a["n"], b["n"]), np.maximum.outer(a["n"], b["n"])
    wanted = (a["c"][:, None] != b["c"]) & (100 * small >= percent * large)
    for k in range(a["i"]):
        wanted &= a["left"][:, k][:, None] != b["left"][:, k]
    shared = np.zeros_like(wanted)
    for k in range(collection):
        shared |= a["right"][:, k][:, None] == b["right"][:, k]
    wanted &= shared
    if one:
        wanted = np.triu(wanted, 1)
    out = [], []
    for x in np.flatnonzero(wanted.any(axis=1)):
        own, others = a["sets"][x], np.flatnonzero(wanted[x])
        sizes = b["n"][others]
        joined = np.concatenate([b["sets"][y] for y in others])
        at = np.minimum(np.searchsorted(own, joined), len(own) - 1)
        ends = np.cumsum(sizes)
        hits = np.cumsum(own[at] == joined)[ends - 1]
        both = np.diff(hits, prepend=0)
        good = others[100 * both >= percent * (len(own) + sizes - both)]
        out[0].extend([a["id"][x]] * len(good))
        out[1].extend(b["id"][good])
    return out


def _places(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    """The block that each row belongs to: left half key, its number, and two piece numbers."""
    return np.column_stack([rows[c].to_numpy() for c in ("l", "i", "low", "high")])


def _starts(place: np.ndarray) -> np.ndarray:
    """Where another block begins, besides the first row."""
    return np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1


def _block_links(rows: pa.Table, collection: int, percent: int) -> pa.RecordBatch:
    """Links inside the blocks of some rows, sorted by block; each block is whole."""
    rows = rows.combine_chunks()
    place = _places(rows)
    starts = np.append(0, _starts(place))
    lists = {c: rows[c].combine_chunks() for c in ("left", "right", "shingles")}
    half = {c: lists[c].flatten().to_numpy().reshape(-1, collection) for c in ("left", "right")}
    bounds, flat = lists["shingles"].offsets.to_numpy(), lists["shingles"].values.to_numpy().view(np.uint64)
    ids, sizes, component, piece = (rows[c].to_numpy() for c in ("m", "n", "c", "piece"))
    out = [], []

    def members(at: np.ndarray) -> dict:
        sets = [flat[bounds[k] : bounds[k + 1]] for k in at]
        return {"i": place[at[0], 1], "id": ids[at], "n": sizes[at], "c": component[at], "sets": sets} | {c: half[c][at] for c in half}

    for start, end in zip(starts, np.append(starts[1:], len(place)), strict=True):
        at = np.arange(start, end)
        low, high = (at[piece[at] == place[start, k]] for k in (2, 3))
        if len(low) and len(high):
            made = _linked(members(low), members(high), collection, percent, place[start, 2] == place[start, 3])
            for column, values in zip(out, made, strict=True):
                column.extend(values)
    return pa.RecordBatch.from_arrays([pa.array(column, pa.int64()) for column in out], ["a", "b"])


def _compared(collection: int, percent: int):
    """Links inside blocks, from rows sorted by block: what is held are an Arrow batch and the rows of an unfinished block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        open_ = None
        for batch in batches:
            if not batch.num_rows:
                continue
            place = _places(batch)
            if held and (place[0] != open_).any():
                yield _block_links(pa.Table.from_batches(held), collection, percent)
                held = []
            starts = _starts(place)
            if len(starts):
                yield _block_links(pa.Table.from_batches([*held, batch.slice(0, starts[-1])]), collection, percent)
                held, batch = [], batch.slice(starts[-1])
            held.append(batch)
            open_ = place[-1]
        if held:
            yield _block_links(pa.Table.from_batches(held), collection, percent)

    return run


def _made_sets(texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``id`` and ``shingles`` of the wanted rows."""
    return texts.join(wanted, "_id", "left_semi").select("_id", "_text").mapInArrow(_sets(width), "id bigint, shingles array<bigint>")


def _confirmed(pairs: DataFrame, texts: DataFrame, sizes: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough.

    Only sets of candidates are made, and only where the sizes allow the similarity.  ``sizes`` has the least and
    greatest set size of an id, ``_least`` and ``_most``.
    """
    a, b = (sizes.select(F.col("_id").alias(end), F.col("_least").alias(f"_l{end}"), F.col("_most").alias(f"_m{end}")) for end in "ab")
    pairs = pairs.join(a, "a").join(b, "b").where(f"100 * _ma >= {int(percent)} * _lb AND 100 * _mb >= {int(percent)} * _la").select("a", "b")
    pairs = durable(pairs)
    sets = _made_sets(texts, pairs.select(F.col("a").alias("_id")).union(pairs.select("b")).distinct(), width)
    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b"
    )
    both = F.size(F.array_intersect("sa", "sb")).cast("bigint")
    either = F.size("sa") + F.size("sb") - both
    return joined.where(100 * both >= percent * either).select("a", "b")


def near_groups(
    docs: DataFrame,
    width: int = 5,
    percent: int = PERCENT,
    collection: int = COLLECTION,
    half: int = HALF,
) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (least id reachable) and ``kept`` of every row.

    Two texts are linked when 100 * |A & B| >= ``percent`` * |A | B| for their sets of ``width``-word shingles
    (lower-case A-Z, words between white space; a shorter text is one shingle; no words: no links).

    *Tensored banding*: two collections of ``collection`` half keys, each of ``half`` minhashes, are made; every
    pair of a left and a right half key is the key of one table, so 2 * collection * half minhashes serve
    collection ** 2 tables of 2 * half rows.  A link of similarity s is missed with a chance of about
    2 * (1 - s ** half) ** collection: 1.5e-3 at 0.8 and 3e-5 at 0.9 with the defaults.

    Rows with the same set (128-bit fingerprint and size) are one representative.  A bucket of representatives
    is not expanded into its pairs.  Candidates are confirmed in three rounds, and what earlier rounds have connected
    is left out: (1) every representative with the least hub of its buckets, (2) with the hub of each bucket, (3)
    members of buckets that still hold different components, with each other.  For (3) they come together with
    their sets by left half key, in blocks of ``BLOCK`` x ``BLOCK`` that split hot groups over tasks, and only links
    leave a task.  Every candidate pair is therefore confirmed or already connected; none is dropped.

    Half keys of all rows are checkpointed (200 bytes a row) and the tables' keys expanded from them.

    Null or empty text: no shingles, its own component.  Null id: never linked, null component, kept.  Rows that
    repeat an id are one representative if their texts agree; otherwise the id links what either links.  No rows
    give no rows.
    """
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    signed = durable(texts.mapInArrow(_signatures(width, collection, half), _SIGNATURE))
    usable = signed.where("_id IS NOT NULL AND n_shingles > 0")
    first = usable.groupBy("f1", "f2", "n_shingles").agg(F.min("_id").alias("rep"))
    # an id that stands for two texts joins them
    reps = usable.join(first.withColumnRenamed("rep", "_id"), ["_id", "f1", "f2", "n_shingles"], "left_semi").dropDuplicates(["_id", "f1", "f2"])
    sizes = reps.groupBy("_id").agg(F.min("n_shingles").alias("_least"), F.max("n_shingles").alias("_most"))
    left = reps.select("_id", "right", F.posexplode("left").alias("i", "l"))
    # the number of the left half key stays readable in the low bits
    hashed = F.xxhash64("i", "j", "l", "r").bitwiseAND(F.lit(-256)).bitwiseOR(F.col("i").cast("bigint"))
    keys = left.select("_id", "i", "l", F.posexplode("right").alias("j", "r")).select(F.col("_id").alias("m"), hashed.alias("key"))
    hubs = keys.groupBy("key").agg(F.min("m").alias("hub"), F.max("m").alias("_last")).where("hub < _last").select("key", "hub")
    buckets = durable(keys.join(hubs, "key"))

    def unlinked(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """Pairs whose ends are in different components so far."""
        a = labels.select(F.col("id").alias("a"), F.col("component").alias("_ca"))
        b = labels.select(F.col("id").alias("b"), F.col("component").alias("_cb"))
        known = pairs.join(a, "a", "left").join(b, "b", "left")
        return known.where(F.coalesce("_ca", "a") != F.coalesce("_cb", "b")).select("a", "b")

    nearest = buckets.where("hub < m").groupBy(F.col("m").alias("b")).agg(F.min("hub").alias("a"))
    tried = nearest.select("a", "b")
    links = durable(_confirmed(tried, texts, sizes, width, percent))
    labels = components(links)
    stars = buckets.where("hub < m").select(F.col("hub").alias("a"), F.col("m").alias("b")).distinct()
    second = durable(unlinked(stars.join(tried, ["a", "b"], "left_anti"), labels))
    links = durable(links.union(_confirmed(second, texts, sizes, width, percent)))
    labels = components(links)
    tagged = buckets.join(labels, buckets["m"] == labels["id"], "left").select("key", "m", F.coalesce("component", "m").alias("c"))
    mixed = tagged.groupBy("key").agg(F.min("c").alias("_low"), F.max("c").alias("_high")).where("_low < _high").select("key")
    open_ = tagged.join(mixed, "key", "left_semi").select("m", "c", F.col("key").bitwiseAND(F.lit(255)).cast("int").alias("i")).distinct()
    known = reps.select(F.col("_id").alias("m"), F.col("n_shingles").alias("n"), "left", "right")
    grouped = durable(open_.join(known, "m").withColumn("l", F.col("left")[F.col("i")]))
    pieces = grouped.groupBy("i", "l").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(BLOCK))).cast("int").alias("pieces"))
    placed = grouped.join(pieces, ["i", "l"]).withColumn("piece", F.pmod(F.xxhash64("m"), "pieces").cast("int"))
    placed = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    placed = placed.withColumn("low", F.least("piece", "_other")).withColumn("high", F.greatest("piece", "_other"))
    sets = _made_sets(texts, grouped.select(F.col("m").alias("_id")).distinct(), width).withColumnRenamed("id", "m")
    block = ["l", "i", "low", "high"]
    shared = placed.drop("_other", "pieces").join(sets, "m").where(F.size("shingles") == F.col("n"))
    # a partition holds many small blocks, and a task one of them at a time
    compared = shared.repartition(*block).sortWithinPartitions(*block, "piece", "m").mapInArrow(
        _compared(collection, percent), "a bigint, b bigint"
    )
    links = durable(links.union(compared.distinct()))

    named = usable.join(first, ["f1", "f2", "n_shingles"])
    own = named.where("_id <> rep").select(F.col("rep").alias("a"), F.col("_id").alias("b")).distinct()
    # copies of a set hang on its representative only; they need no rounds unless an id has several texts
    several = usable.select("_id", "f1", "f2").distinct().groupBy("_id").count().where("count > 1").select("_id")
    tied = own.join(several.withColumnRenamed("_id", "b"), "b", "left_semi").select("a", "b")
    final = components(links.union(tied))
    by_set = first.join(final, F.col("rep") == F.col("id"), "left").select(
        "f1", "f2", "n_shingles", F.coalesce("component", "rep").alias("component_id")
    )
    out = signed.select("_id", "f1", "f2", "n_shingles").join(by_set, ["f1", "f2", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("_id"))
    component = F.when(F.col("_id").isNotNull(), component)
    return out.select(
        F.col("_id").alias("doc_id"), "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("_id")).alias("kept")
    )


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose id is the least of their component; columns as given."""
    names = docs.columns
    gone = near_groups(docs, width, percent).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    rows = docs.select(F.col("doc_id").alias("_gone"), F.struct(*(F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names))).alias("_row"))
    left = rows.join(gone, "_gone", "left_anti")
    return left.select(*(F.col(f"_row.c{i}").alias(n) for i, n in enumerate(names)))


def near_dedup_query(documents: DataFrame) -> DataFrame:
    return near_groups(documents, width=2)
