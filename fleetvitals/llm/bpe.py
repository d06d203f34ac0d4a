"""Byte-level BPE: merges compiled into a lazily determinised transducer, and a streaming decoder."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
# Bounds on what a Python worker remembers; beyond them it starts anew, with the same results.
MEMORY_STATES = 200_000
MEMORY_PIECES = 400_000
LONGEST_REMEMBERED = 64
# Bytes of a piece that states are made for; beyond them only states that are there already are used.
DETERMINISED = 4
# Below it all readings of Unicode agree on what a letter is.
LATIN_END = "\u0250"


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class MergeTransducer:
    """Turns the bytes of one piece into BPE tokens, left to right.

    A sequence of tokens is the BPE encoding of its bytes just when every two neighbours, merged on their own,
    stay the two they are.  So the tokens of a piece are a path of a nondeterministic transducer: it walks down
    a trie of tokens, may end a token where the trie has one, and must then go on with a neighbour that stays.
    There is exactly one such path for every prefix of a piece.

    The transducer is determinised as it runs: a state is the set of walks still alive, each with the tokens not
    yet emitted, its last token and its place in the trie.  What all walks agree on is emitted; how long they can
    differ is bounded by the longest token.  (state, byte) -> (state, emitted) is kept for the next piece.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for data, rank in ranks.items():
            node = 0
            for byte in data:
                following = self.children[node].get(byte)
                if following is None:
                    following = len(self.children)
                    self.children[node][byte] = following
                    self.children.append({})
                    self.token.append(-1)
                node = following
            self.token[node] = rank
        self.data = {rank: data for data, rank in ranks.items()}
        self._made_of: dict[int, tuple[int, int] | None] = {}
        self._stay: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        self._ids: dict[tuple, int] = {}
        self._states: list[tuple] = []
        self._moves: list[dict[int, tuple[int, tuple[int, ...]]]] = []
        # what is left to emit where a piece ends; None if no token ends there
        self._ends: list[tuple[int, ...] | None] = []
        self._state((((), -1, 0),))

    def _merge(self, data: bytes, steps: int) -> list[bytes]:
        """Merge the neighbours of least rank, leftmost first, ``steps`` times at most."""
        parts, none = [data[i : i + 1] for i in range(len(data))], len(self.ranks) + 1
        for _ in range(steps):
            at = [self.ranks.get(x + y, none) for x, y in zip(parts, parts[1:])]
            best = min(at, default=none)
            if best == none:
                break
            i = at.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte, or if merging never makes it."""
        if token not in self._made_of:
            parts = self._merge(self.data[token], len(self.data[token]) - 2)
            joined = len(parts) == 2 and parts[0] + parts[1] == self.data[token]
            self._made_of[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if joined else None
        return self._made_of[token]

    def _neighbours(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both gives just these two.

        Their merges are undone from the last to the first.  Each time, the two tokens that touch must not be
        mergeable before the merge just undone; on equal rank the merge further left comes first.
        """
        if left < 0:
            return len(self.data[right]) == 1 or self._halves(right) is not None
        pair = (left, right)
        stays = self._stay.get(pair)
        if stays is None:
            if len(self._stay) > MEMORY_STATES:
                self._stay.clear()
            stays = self._stay[pair] = self._undone(left, right)
        return stays

    def _undone(self, left: int, right: int) -> bool:
        data, rank_of = self.data, self.ranks.get
        if len(data[right]) > 1 and self._halves(right) is None:
            return False
        # the merges that must come first: of this rank or less on the left, less on the right
        bound, inclusive = len(self.ranks) + 1, False
        while True:
            across = rank_of(data[left] + data[right])
            if across is not None and (across < bound or inclusive and across == bound):
                return False
            last, first = self._halves(left), self._halves(right)
            if last is None and first is None:
                return True
            if first is None or last is not None and left > right:
                # the merge across is right of this one, so it needs a lower rank
                bound, inclusive, left = left, False, last[1]
            else:
                bound, inclusive, right = right, True, first[0]

    def _state(self, walks: tuple) -> int:
        known = self._ids.get(walks)
        if known is None:
            known = self._ids[walks] = len(self._states)
            self._states.append(walks)
            self._moves.append({})
            self._ends.append(walks[-1][0] if walks[-1][2] == 0 else None)
        return known

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        children, tokens, stays = self.children, self.token, self._stay.get
        walks, ended = [], None
        for waiting, last, node in self._states[state]:
            following = children[node].get(byte)
            if following is None:
                continue
            if children[following]:
                walks.append((waiting, last, following))
            token = tokens[following]
            if token >= 0 and ended is None:
                stay = stays((last, token))
                if self._neighbours(last, token) if stay is None else stay:
                    # the one encoding of what has been read
                    ended = ((*waiting, token), token, 0)
        # walks stay in the order of where their open token began, so equal sets are equal tuples
        if ended:
            walks.append(ended)
        first = walks[0][0]
        agreed = len(first)
        for waiting, _, _ in walks if agreed else ():
            agreed = min(agreed, len(waiting))
            while first[:agreed] != waiting[:agreed]:
                agreed -= 1
        if agreed:
            walks = [(waiting[agreed:], last, node) for waiting, last, node in walks]
        made = (self._state(tuple(walks)), first[:agreed])
        self._moves[state][byte] = made
        return made

    def encode(self, data: bytes) -> list[int]:
        """Tokens of one piece."""
        if len(self._states) > MEMORY_STATES:
            self._reset()
        out: list[int] = []
        moves, state = self._moves, 0
        for at, byte in enumerate(data):
            try:
                state, emitted = moves[state][byte]
            except KeyError:
                if at >= DETERMINISED:
                    return out + self._followed(state, data, at)
                state, emitted = self._move(state, byte)
            if emitted:
                out += emitted
        return out + list(self._ends[state])

    def _followed(self, state: int, data: bytes, at: int) -> list[int]:
        """Tokens from a state to the end of a piece, by following its walks one by one and making no states.

        Far into a piece few sets of walks are met again.  As every prefix has one path, a place is reached once at most,
        whatever is tried, so the time is linear.
        """
        for waiting, last, node in self._states[state]:
            path = self._path(last, node, data, at)
            if path is not None:
                return [*waiting, *path]
        raise ValueError("no tokens for these bytes")

    def _path(self, last: int, node: int, data: bytes, at: int) -> list[int] | None:
        """The tokens that lead a walk to the end of the bytes, longest tokens tried first; None if it doesn't get there."""
        children, tokens, known, size = self.children, self.token, self._stay.get, len(data)
        path: list[int] = []
        left: list[tuple[list[tuple[int, int]], int]] = []
        while True:
            ends = []
            while at < size:
                node = children[node].get(data[at])
                if node is None:
                    break
                at += 1
                if tokens[node] >= 0:
                    ends.append((tokens[node], at))
            while True:
                if not ends:
                    if not left:
                        return None
                    ends, last = left.pop()
                    path.pop()
                    continue
                token, at = ends.pop()
                stay = known((last, token))
                if self._neighbours(last, token) if stay is None else stay:
                    break
            path.append(token)
            if at == size:
                return path
            left.append((ends, last))
            last, node = token, 0


class Utf8Stream:
    """Decodes bytes that arrive in any portions; holds back at most three bytes of an unfinished character.

    The state is the unfinished bytes: the lead byte says how many are to follow.
    """

    def __init__(self) -> None:
        self.open = b""

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """How many bytes at the end begin a character that isn't complete."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte >= 0xC0:
                length = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                return back if back < length else 0
            if byte < 0x80:
                return 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.open + data
        held = self._unfinished(data)
        self.open = data[len(data) - held :]
        return data[: len(data) - held].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.open = self.open, b""
        return rest.decode("utf-8", "replace")


class Codec:
    """Encodes texts piece by piece and decodes ids."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.transducer = MergeTransducer(self.ranks)
        self.split = regex.compile(pattern).findall
        self.names = [str(i) for i in range(max(self.ranks.values(), default=-1) + 1)]
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.by_word = pattern == PATTERN
        self.line_break = self._pieces("\n")

    def _remember(self, memory: dict, key: str, ids: tuple[int, ...]) -> tuple[int, ...]:
        if len(key) <= LONGEST_REMEMBERED:
            if len(memory) >= MEMORY_PIECES:
                memory.clear()
            memory[key] = ids
        return ids

    def _piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        whole = self.ranks.get(data)
        return self._remember(self.pieces, piece, tuple(self.transducer.encode(data)) if whole is None else (whole,))

    def _pieces(self, text: str) -> list[int]:
        known, ids = self.pieces.get, []
        for piece in self.split(text):
            found = known(piece)
            ids += found if found is not None else self._piece(piece)
        return ids

    def _word(self, word: str) -> tuple[int, ...]:
        """A word and the space before it."""
        found = self.words.get(word)
        if found is not None:
            return found
        if word.isalpha() and max(word) < LATIN_END:
            # letters and the space before them are one piece
            data = f" {word}".encode()
            whole = self.ranks.get(data)
            return self._remember(self.words, word, tuple(self.transducer.encode(data)) if whole is None else (whole,))
        return self._remember(self.words, word, tuple(self._pieces(f" {word}")))

    def encode(self, text: str) -> list[int]:
        """Ids of a text.

        With the pattern of the rank files, a space or line break between two other characters begins a piece, and
        nothing looks behind it.  So where white space is single spaces and line breaks, the text is encoded word by
        word, and words are remembered with the space before them.  Other texts are matched as a whole.
        """
        lines = text.split("\n")
        rows = [line.split(" ") for line in lines]
        if not self.by_word or sum(map(len, rows)) != len(plain := text.split()) or [w for row in rows for w in row] != plain:
            return self._pieces(text)
        known, ids = self.words.get, []
        for i, row in enumerate(rows):
            if i:
                ids += self.line_break
            ids += self._pieces(row[0])
            rest = row[1:]
            found = list(map(known, rest))
            if None in found:
                found = [ids_ if ids_ is not None else self._word(word) for word, ids_ in zip(rest, found, strict=True)]
            ids += chain.from_iterable(found)
        return ids

    def decode(self, ids: Iterable[int], portion: int = 4096) -> Iterator[str]:
        """Text of the ids in portions, each complete characters."""
        stream, data, ids = Utf8Stream(), self.transducer.data, list(ids)
        for start in range(0, len(ids), portion):
            yield stream.feed(b"".join(map(data.__getitem__, ids[start : start + portion])))
        yield stream.close()


@lru_cache(maxsize=2)
def codec(path: str = VOCABULARY, pattern: str = PATTERN) -> Codec:
    """One codec for each worker process."""
    return Codec(path, pattern)


def _encoded(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ids = [coder.encode(text) for text in part.column(1).fill_null("").to_pylist()]
                lists = pa.array(ids, type=pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``doc_id`` and ``ids``, the tokens of the whole text, one row for each row of ``docs``.

    Pieces, the matches of ``pattern``, are encoded separately and without special tokens.  A null or empty text
    has no ids; null and repeated ids are kept as they are; texts of any length take time in proportion, and no
    rows give no rows.  The vocabulary file must be at ``path`` on every executor.
    """
    return docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text")).mapInArrow(
        _encoded(path, pattern), "doc_id bigint, ids array<int>"
    )


def _decoded(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = ["".join(coder.decode(ids or ())) for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decode(encoded: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``doc_id`` and ``text`` of rows of ``doc_id`` and ``ids``; no ids give an empty text, broken UTF-8 U+FFFD."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoded(path, pattern), "doc_id bigint, text string")


def _digests(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, pattern)
        names = coder.names
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                counts, ids_sums, text_sums = [], [], []
                for text in part.column(1).fill_null("").to_pylist():
                    ids = coder.encode(text)
                    counts.append(len(ids))
                    ids_sums.append(hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
                    whole = hashlib.sha256()
                    for piece in coder.decode(ids):
                        whole.update(piece.encode())
                    text_sums.append(whole.hexdigest())
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(ids_sums, pa.string()), pa.array(text_sums, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def round_trip(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``: encoded and decoded again in one pass.

    Cases as in ``encode``; an empty text has the digests of no bytes.
    """
    return docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text")).mapInArrow(
        _digests(path, pattern), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )


def bpe_query(documents: DataFrame) -> DataFrame:
    return round_trip(documents)
