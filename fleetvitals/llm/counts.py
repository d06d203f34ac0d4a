"""Token counts of a unigram tokenizer, by dynamic programming shared over a trie of pre-tokens."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetvitals.llm.bpe import PATTERN, VOCABULARY, load_ranks

# Bound on what a Python worker remembers; beyond it the trie is started anew, with the same counts.
MEMORY_NODES = 600_000
LONGEST_SHARED = 64


def rank_scores(ranks: dict[bytes, int]) -> dict[bytes, float]:
    """Log-probabilities of a vocabulary whose ranks follow falling frequency, by Zipf's law.

    The tokenizer files hold ranks and no probabilities, and tokenizers are not trained here.
    """
    total = math.log(sum(1 / (rank + 1) for rank in ranks.values()))
    return {token: -math.log(rank + 1) - total for token, rank in ranks.items()}


class SharedForward:
    """Best segmentations of pre-tokens, with a forward score for each prefix, computed once.

    Pre-tokens are inserted into a trie of bytes.  A node stands for a prefix and holds the score of its best
    segmentation and that segmentation's number of tokens; pre-tokens with the same beginning share the nodes.
    A new node looks back over the tokens that may end there, found in a trie of the vocabulary read backwards.
    Of equal scores the fewer tokens win.
    """

    def __init__(self, scores: dict[bytes, float]):
        self.backward: list[dict[int, int]] = [{}]
        self.ends: list[float | None] = [None]
        for token, score in scores.items():
            node = 0
            for byte in reversed(token):
                following = self.backward[node].get(byte)
                if following is None:
                    following = self.backward[node][byte] = len(self.backward)
                    self.backward.append({})
                    self.ends.append(None)
                node = following
            self.ends[node] = score
        self.reset()

    def reset(self) -> None:
        self.children: dict[int, int] = {}
        self.best: list[float] = [0.0]
        self.count: list[int] = [0]

    def _look_back(self, data: bytes, end: int, path: list[int]) -> tuple[float, int]:
        node, best, count = 0, -math.inf, 0
        for start in range(end - 1, -1, -1):
            node = self.backward[node].get(data[start])
            if node is None:
                break
            score = self.ends[node]
            if score is not None:
                before = path[start]
                score += self.best[before]
                tokens = self.count[before] + 1
                if score > best or score == best and tokens < count:
                    best, count = score, tokens
        if count == 0:
            raise ValueError(f"the vocabulary has no token for byte {data[end - 1]}")
        return best, count

    def tokens(self, data: bytes) -> int:
        """Number of tokens in the best segmentation of a pre-token."""
        if len(self.best) > MEMORY_NODES:
            self.reset()
        children, path, node = self.children, [0], 0
        for at, byte in enumerate(data):
            key = node << 8 | byte
            following = children.get(key)
            if following is None:
                best, count = self._look_back(data, at + 1, path)
                following = children[key] = len(self.best)
                self.best.append(best)
                self.count.append(count)
            node = following
            path.append(node)
        return self.count[node]


class Counter:
    def __init__(self, path: str, pattern: str):
        self.forward = SharedForward(rank_scores(load_ranks(path)))
        self.split = regex.compile(pattern).findall
        self.terminals: dict[str, int] = {}

    def _terminal(self, piece: str) -> int:
        if len(piece) > LONGEST_SHARED:
            # a long pre-token shares little; its nodes are given back at once
            kept = self.forward.children, self.forward.best, self.forward.count
            self.forward.reset()
            found = self.forward.tokens(piece.encode())
            self.forward.children, self.forward.best, self.forward.count = kept
            return found
        if len(self.terminals) > MEMORY_NODES // 2:
            self.terminals.clear()
        found = self.terminals[piece] = self.forward.tokens(piece.encode())
        return found

    def count(self, text: str) -> tuple[int, int]:
        """Pre-tokens and tokens of a text."""
        known, total = self.terminals.get, 0
        pieces = self.split(text)
        for piece in pieces:
            found = known(piece)
            total += found if found is not None else self._terminal(piece)
        return len(pieces), total


@lru_cache(maxsize=2)
def counter(path: str, pattern: str) -> Counter:
    """One counter for each worker process."""
    return Counter(path, pattern)


def _counted(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, pattern).count
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [count(text) for text in part.column(1).fill_null("").to_pylist()]
                columns = [part.column(0), *(pa.array([f[i] for f in found], pa.int64()) for i in range(2))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_pretokens", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``doc_id``, ``n_pretokens`` and ``n_tokens`` of the whole text, one row for each row of ``docs``.

    Pre-tokens are the matches of ``pattern``; each is segmented into vocabulary tokens so that the sum of their
    unigram log-probabilities is greatest (ties: fewest tokens).

    A null or empty text has none of either; null and repeated ids stay as they are; texts of any length take time
    in proportion; no rows give no rows.  The vocabulary file must be at ``path`` on every executor.
    """
    return docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text")).mapInArrow(
        _counted(path, pattern), "doc_id bigint, n_pretokens bigint, n_tokens bigint"
    )


def token_counts_query(documents: DataFrame) -> DataFrame:
    return token_counts(documents)
