"""Words of many texts at once, as numpy arrays over Arrow's own text buffers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa

# Bytes of text worked on at once; the arrays below hold about 60 bytes for each.
SLICE_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# \x20 and \x09-\x0D
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
# all but letters, digits and bytes of longer characters
NO_LETTER = np.ones(256, dtype=bool)
NO_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the finalizer of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x = x ^ (x >> np.uint64(33))
    x = x * _M2
    return x ^ (x >> np.uint64(33))


def numbers(seed: int, count: int) -> np.ndarray:
    """Fixed pseudo-random 64-bit numbers."""
    return mix64(mix64(np.arange(1, count + 1, dtype=np.uint64) * _BASE + np.uint64(seed)))


_BYTE = numbers(1, 256)


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse."""
    base = int(_BASE)
    up, down = np.full(size, base, dtype=np.uint64), np.full(size, pow(base, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(SLICE_BYTES + 1, 1 << int(size).bit_length()) if size > SLICE_BYTES else SLICE_BYTES + 1)


@dataclass
class Texts:
    """UTF-8 bytes of some texts, end to end; text i is data[bounds[i]:bounds[i + 1]]."""

    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1


def text_bytes(column: pa.Array | pa.ChunkedArray) -> Texts:
    """The buffers of an Arrow text column without a copy; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return Texts(data, bounds)


def slices(texts: Texts, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """(first, end, texts) with about ``size`` bytes each; a longer text stands alone."""
    first = 0
    while first < len(texts):
        end = int(np.searchsorted(texts.bounds, texts.bounds[first] + size, side="right")) - 1
        end = min(max(end, first + 1), len(texts))
        start, stop = texts.bounds[first], texts.bounds[end]
        yield first, end, Texts(texts.data[start:stop], texts.bounds[first : end + 1] - start)
        first = end


@dataclass
class Words:
    """Words of some texts: 64-bit hash, first byte and length in bytes; words of text i are at first[i]:first[i + 1]."""

    hashes: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    first: np.ndarray
    prefixes: list[np.ndarray] = field(default_factory=list)


def words(texts: Texts, separators: np.ndarray = _SPACE, prefixes: tuple[int, ...] = ()) -> Words:
    """Lower-case (A-Z) words between white space (space, \\t to \\r), hashed in one pass over the bytes.

    ``prefixes``: also hash the first so many bytes of every word that has them (0 where it hasn't).
    """
    data, bounds = texts.data, texts.bounds
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(none.astype(np.uint64), none, none, np.zeros(len(bounds), np.int64), [none.astype(np.uint64) for _ in prefixes])
    space = separators[data]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    after = np.empty(len(data), dtype=bool)
    after[0], after[1:] = True, space[:-1]
    after[inner] = True
    before = np.empty(len(data), dtype=bool)
    before[-1], before[:-1] = True, space[1:]
    before[inner - 1] = True
    starts, ends = np.flatnonzero(after & ~space), np.flatnonzero(before & ~space)
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * up[: len(data)], out=sums[1:])
    lengths = ends + 1 - starts
    hashes = mix64((sums[ends + 1] - sums[starts]) * down[starts] + lengths.astype(np.uint64))
    heads = []
    for size in prefixes:
        stop = np.minimum(starts + size, len(data))
        head = mix64((sums[stop] - sums[starts]) * down[starts] + np.uint64(size))
        heads.append(np.where(lengths >= size, head, np.uint64(0)))
    return Words(hashes, starts, lengths, np.searchsorted(starts, bounds), heads)


def runs(texts: Texts, sizes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size the hashes of so many characters in a row, all of three bytes or more, and the text each is in."""
    data, bounds = texts.data, texts.bounds
    if not (data >= 0xE0).any():
        return
    begins = np.flatnonzero((data & 0xC0) != 0x80)
    ends = np.append(begins[1:], len(data))
    owner = np.searchsorted(bounds, begins, side="right") - 1
    short = np.concatenate([[0], np.cumsum(data[begins] < 0xE0)])
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    for size, salt in zip(sizes, numbers(3, len(sizes)), strict=True):
        i = np.arange(max(len(begins) - size + 1, 0))
        i = i[(short[i + size] == short[i]) & (owner[i] == owner[i + size - 1])]
        yield mix64((sums[ends[i + size - 1]] - sums[begins[i]]) * down[begins[i]] + salt), owner[i]


def shingles(found: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` words in a row, and where each text's begin; shorter texts have one of all their words."""
    counts = np.diff(found.first)
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    first = np.zeros(len(made) + 1, dtype=np.int64)
    np.cumsum(made, out=first[1:])
    at = np.arange(first[-1]) + np.repeat(found.first[:-1] - first[:-1], made)
    out = np.zeros(len(at), dtype=np.uint64)
    room = np.repeat(np.minimum(counts, width), made)
    padded = np.concatenate([found.hashes, np.zeros(width, np.uint64)])
    for step, factor in enumerate(numbers(2, width)):
        # position counts: the same words in another order are another shingle
        out += np.where(room > step, mix64(padded[at + step] ^ factor), np.uint64(0))
    return mix64(out + room.astype(np.uint64)), first


def distinct(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each segment."""
    parts = [np.unique(hashes[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    bounds = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum(sizes, out=bounds[1:])
    return (np.concatenate(parts) if parts else hashes[:0]), bounds
