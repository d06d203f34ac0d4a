"""Approximate nearest neighbours by inner product: a forest of long hash strings in sorted arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetvitals.plans import durable

TREES = 64
BITS = 60
# Points in a full block, about, and places in its trees that a query climbs to at least; a smaller block has its share.
BLOCK = 16_384
CANDIDATES = 12_288
# Queries that meet a block in one task, about.
PIECE = 16_384
# Lengths in one band differ by this factor at most; bands are put together up to this part of a block, and a block
# so small is looked at as a whole.
RATIO = 1.1
SMALL = 16
TOP = 20
SPARE = 32
SEED = 11


def usable(vector: Column) -> Column:
    """Whether a vector takes part: some component, none null or not finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column; missing components at the end are 0."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), width))
    out[np.repeat(np.arange(len(column)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _hashed(width: int, queries: bool):
    """Hash strings, one number of BITS bits for each tree, of batches of (id, vector), for points (id, vector, block, norm).

    A point gets the component that makes its length ``norm``, a query 0 there, so angles order as inner products.
    """
    planes = np.random.default_rng(SEED).standard_normal((width + 1, TREES * BITS))
    weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                x = _matrix(part.column(1), width)
                rest = np.zeros(len(x)) if queries else np.sqrt(np.maximum(part.column(3).to_numpy() ** 2 - (x**2).sum(1), 0))
                bits = (np.column_stack([x, rest]) @ planes > 0).reshape(len(x), TREES, BITS)
                keys = (bits @ weights).ravel()
                lists = pa.ListArray.from_arrays(np.arange(0, len(keys) + 1, TREES, dtype=np.int32), keys)
                kept, names = part.columns[:2] if queries else part.columns[:3], ["id", "v"] if queries else ["id", "v", "block"]
                yield pa.RecordBatch.from_arrays([*kept, lists], [*names, "keys"])

    return run


def _length(values: np.ndarray) -> np.ndarray:
    """Bits that numbers of at most BITS bits need; halves of them are exact in a double."""
    upper, lower = values >> 30, values & ((1 << 30) - 1)
    return np.where(upper > 0, np.frexp(upper)[1] + 30, np.frexp(lower)[1])


class Forest:
    """Sorted arrays of hash strings, one for each tree, over the points of a block."""

    def __init__(self, keys: np.ndarray):
        """``keys``: points x trees."""
        self.order = np.argsort(keys, axis=0, kind="stable").T
        self.sorted = np.take_along_axis(keys.T, self.order, axis=1)

    def ranges(self, wanted: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Where a tree's array has the first ``level`` bits of strings: trees x queries, each tree's in order of the string.

        Strings in order are found several times as fast as in any order, as each search begins where the last one ended.
        """
        low = wanted >> (BITS - level) << (BITS - level)
        last = low + (np.int64(1) << (BITS - level))
        return tuple(np.stack([np.searchsorted(keys, edge[t]) for t, keys in enumerate(self.sorted)]) for edge in (low, last))

    def depths(self, wanted: np.ndarray) -> np.ndarray:
        """The longest prefix that each string, in order in its tree, has in common with a point: it is one of its neighbours."""
        out = np.zeros(wanted.shape, dtype=np.int64)
        for t, keys in enumerate(self.sorted):
            at = np.searchsorted(keys, wanted[t])
            near = [keys[np.clip(at + step, 0, len(keys) - 1)] for step in (-1, 0)]
            out[t] = BITS - np.minimum(*[_length(wanted[t] ^ found) for found in near])
        return out

    def candidates(self, wanted: np.ndarray, enough: int) -> Iterator[np.ndarray]:
        """For each query the points found: down to the longest prefix any tree has in common with it, then up in all
        trees at once, a bit at a time, until ``enough`` places have been passed or all trees are at their roots."""
        trees = len(self.sorted)
        by_string = np.argsort(wanted, axis=0, kind="stable").T
        strings = np.take_along_axis(wanted.T, by_string, axis=1)
        low, high = (np.zeros((len(wanted), trees), dtype=np.int64) for _ in range(2))
        open_ = np.ones(len(wanted), dtype=bool)
        for level in range(int(self.depths(strings).max(initial=0)), -1, -1):
            # as many open queries in every tree, in each tree's order
            still = open_[by_string]
            queries = by_string[still].reshape(trees, -1)
            tree = np.arange(trees)[:, None]
            for places, found in zip((low, high), self.ranges(strings[still].reshape(trees, -1), level), strict=True):
                places[queries, tree] = found
            open_ &= (high - low).sum(axis=1) < enough
            if not open_.any():
                break
        for a, b in zip(low, high, strict=True):
            found = np.zeros(self.order.shape[1], dtype=bool)
            for order, i, j in zip(self.order, a, b, strict=True):
                found[order[i:j]] = True
            yield np.flatnonzero(found)


def _keys(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, TREES)


def _groups(bands: list[tuple[int, int, float]], block: int) -> list[tuple[int, int, int, float]]:
    """(band, first block, blocks, norm) from (band, points, greatest length) in order of band.

    Neighbouring bands are put together while they have block / ``SMALL`` points at most, so there are no more groups
    than a fixed number for each block of points.
    """
    groups: list[tuple[list[int], int, float]] = []
    for band, points, norm in bands:
        if groups and groups[-1][1] + points <= block // SMALL:
            groups[-1] = ([*groups[-1][0], band], groups[-1][1] + points, max(groups[-1][2], norm))
        else:
            groups.append(([band], points, norm))
    out, first = [], 0
    for members, points, norm in groups:
        blocks = -(-points // block)
        out += [(band, first, blocks, norm) for band in members]
        first += blocks
    return out


def _searched(width: int, top: int, candidates: int, block: int):
    """The best candidates of a block for each query of a piece."""

    def run(key: tuple, points: pa.Table, queries: pa.Table) -> pa.Table:
        schema = pa.schema([("q", pa.int64()), ("p", pa.int64()), ("score", pa.float64())])
        if not points.num_rows or not queries.num_rows:
            return schema.empty_table()
        points, queries = points.combine_chunks().sort_by("id"), queries.combine_chunks()
        ids, asked = points["id"].to_numpy(), queries["id"].to_numpy()
        x, y = (_matrix(side["v"].combine_chunks(), width) for side in (points, queries))
        forest = Forest(_keys(points["keys"].combine_chunks()))
        n = len(ids)
        enough = TREES * n if n <= block // SMALL else -(-candidates * n // block)
        out = []
        for i, found in enumerate(forest.candidates(_keys(queries["keys"].combine_chunks()), enough)):
            # products of many queries at once cost less than picking rows; the best, with some to spare, are then
            # scored alike in every batch
            if i % 64 == 0:
                rough = y[i : i + 64] @ x.T
            if len(found) > top + SPARE:
                found = np.sort(found[np.argpartition(-rough[i % 64, found], top + SPARE)[: top + SPARE]])
            score = (x[found] * y[i]).sum(axis=1)
            # found is in order of id, so equal scores stay so
            best = np.argsort(-score, kind="stable")[:top]
            out.append((np.full(len(best), asked[i]), ids[found[best]], score[best]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=schema)

    return run


def nearest(
    table: DataFrame, is_query: Column, top: int = TOP, candidates: int = CANDIDATES, block: int = BLOCK, piece: int = PIECE
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: for each row of ``table`` (``vec_id``, ``embedding``) where
    ``is_query`` holds, the ``top`` other rows of largest inner product among the candidates found.

    Points are put into bands of about the same length, and a band's are dealt by hash into blocks of about ``block``; a
    block has a forest of its own.  *Index*: a point gets one more component that makes its length the greatest of its
    band, which is small as lengths in a band are; every tree gives it a long string of bits, the sides of random planes
    it lies on, and holds them sorted.  *Descent*: a query's longest matching prefix is found in the trees.  *Ascent*: the
    prefix is shortened in all trees at once until ``candidates`` places are passed, or in a block of m points
    ``candidates`` x m / ``block``; those points are scored in double precision.  The share of a block that is looked at
    depends neither on the size of the table nor on how full the block is; blocks of ``block`` / ``SMALL`` points or
    fewer are looked at as a whole.  The work is queries x points x that share.

    Queries are dealt by hash into pieces of about ``piece``.  A task has one block and one piece, so that neither side
    grows with the table; each piece has a copy of the points.

    Equal vectors are one point in the forest, with its ``top`` + 1 smallest ids: no more of them can be among the
    nearest; equal queries are searched once.

    Components may be float or double and stay as they are; scores are double.  Vectors that are null, empty, zero, or hold null, NaN or infinite components take no part.  Shorter vectors count
    as ended by zeros.  Null ids are left out; rows that repeat id and vector count once.  Fewer rows than ``top``:
    those there are.  No rows give no rows.
    """
    rows = table.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), is_query.alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v")))
    # -0.0 and 0.0 are one number; the copies of a vector are counted by its bytes
    kind = rows.schema["v"].dataType.simpleString()
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0).cast("float")).cast(kind)).dropDuplicates(["id", "v"])

    copies = Window.partitionBy("v").orderBy("id")
    mates = rows.select("id", "v", F.row_number().over(copies).alias("nth")).where(F.col("nth") <= top + 1)
    mates = durable(mates.withColumn("p", F.first("id").over(copies)))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x))
    # lengths of about 1 lie in the middle of a band
    band = F.floor(F.log(length) / float(np.log(RATIO)) + 0.5).cast("int")
    distinct = mates.where("nth = 1").select("id", "v", length.alias("length"), band.alias("band"))
    counted = distinct.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("norm"), F.max(F.size("v")).alias("width")).orderBy("band").collect()
    width = max((r["width"] for r in counted), default=1)
    groups = _groups([(r["band"], r["n"], r["norm"]) for r in counted], block)
    blocks = max((first + many for _, first, many, _ in groups), default=1)
    # a float has fewer than 2,000 bands
    groups = F.broadcast(table.sparkSession.createDataFrame(groups, "band int, first int, blocks int, norm double"))

    points = distinct.join(groups, "band").withColumn("block", F.col("first") + F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    indexed = points.select("id", "v", "block", "norm").mapInArrow(_hashed(width, False), f"id bigint, v {kind}, block int, keys array<bigint>")
    indexed = durable(indexed)
    asking = rows.where("asks").groupBy("v").agg(F.min("id").alias("id"))
    asked = durable(asking.select("id", "v").mapInArrow(_hashed(width, True), f"id bigint, v {kind}, keys array<bigint>"))
    pieces = -(-max(asked.count(), 1) // piece)

    copied = indexed.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    queries = asked.withColumn("piece", F.pmod(F.xxhash64("id"), F.lit(pieces)).cast("int"))
    queries = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = copied.groupBy("block", "piece").cogroup(queries.groupBy("block", "piece"))
    scored = met.applyInArrow(_searched(width, top + 1, candidates, block), "q bigint, p bigint, score double")
    by_score = Window.partitionBy("q").orderBy(F.col("score").desc(), "p")
    best = scored.withColumn("nth", F.row_number().over(by_score)).where(F.col("nth") <= top + 1).drop("nth")
    named = rows.where("asks").select(F.col("id").alias("query_id"), "v").join(asked.select(F.col("id").alias("q"), "v"), "v").select("query_id", "q")
    pairs = best.join(mates.select("p", F.col("id").alias("vec_id")), "p").join(named, "q").where("query_id <> vec_id")
    ranked = pairs.select("query_id", "vec_id", "score", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")).alias("rank"))
    return ranked.where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def nearest_query(embeddings: DataFrame) -> DataFrame:
    return nearest(embeddings, F.col("vec_id") % 20 == 0)
