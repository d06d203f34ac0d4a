"""Quality classifier: histogram gradient-boosted trees over statistics of a document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetvitals.llm import text
from fleetvitals.llm.labels import SAMPLE_ROWS, fold, labelled_sample, sample_texts

BINS = 64
DEPTH = 4
TREES = 80
RATE = 0.15
L2 = 1.0
LEAST_WEIGHT = 1.0

_CLASSES = {
    "upper": [*range(65, 91)],
    "digits": [*range(48, 58)],
    "spaces": [9, 10, 11, 12, 13, 32],
    "long characters": [*range(128, 256)],
    "sentence marks": [33, 44, 46, 63],
    "exclamations": [33],
    "symbols": [b for b in range(33, 127) if not chr(b).isalnum() and b not in (33, 44, 46, 63)],
    "bars": [124],
}
STATISTICS = (
    "bytes", "words", "word length", "lines", "line length", *_CLASSES, "distinct words", "distinct pairs", "distinct fives",
    "same neighbours", "longest word", "no letters", "capitals", "distinct lines", "commonest word",
)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the segments between bounds."""
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _distinct(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct values of each segment, and how often its commonest occurs."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(owner[order], kind="stable")]
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    starts = np.flatnonzero(new)
    runs = np.diff(np.append(starts, len(h)))
    most = np.zeros(len(bounds) - 1)
    np.maximum.at(most, o[starts], runs)
    return np.bincount(o[starts], minlength=len(bounds) - 1).astype(float), most


def statistics(texts: text.Texts) -> np.ndarray:
    """One row of STATISTICS for each text; an empty text has zeros."""
    size = np.diff(texts.bounds).astype(float)
    found = text.words(texts)
    n = np.diff(found.first).astype(float)
    one, some = np.maximum(size, 1), np.maximum(n, 1)
    columns = [np.log1p(size), np.log1p(n), _sums(found.lengths, found.first) / some]
    breaks = np.cumsum(np.append(0, texts.data == 10))
    lines = np.where(size > 0, breaks[texts.bounds[1:]] - breaks[texts.bounds[:-1]] + 1.0, 0)
    columns += [np.log1p(lines), size / np.maximum(lines, 1)]
    for members in _CLASSES.values():
        mask = np.zeros(256, dtype=bool)
        mask[members] = True
        columns.append(_sums(mask[texts.data], texts.bounds) / one)
    distinct, commonest = _distinct(found.hashes, found.first)
    columns.append(distinct / some)
    for width in (2, 5):
        grams, bounds = text.shingles(found, width)
        columns.append(_distinct(grams, bounds)[0] / np.maximum(np.diff(bounds), 1))
    if len(found.hashes):
        same = np.append(found.hashes[1:] == found.hashes[:-1], False)
        ends = found.first[1:][n > 0] - 1
        same[ends] = False
        letters = np.cumsum(np.append(0, ~text.NO_LETTER[texts.data]))
        bare = letters[found.starts + found.lengths] == letters[found.starts]
        first = texts.data[found.starts]
        capital = (first >= 65) & (first <= 90)
        longest = np.zeros(len(n))
        np.maximum.at(longest, np.repeat(np.arange(len(n)), n.astype(int)), found.lengths)
    else:
        same = bare = capital = np.zeros(0)
        longest = np.zeros(len(n))
    columns += [_sums(same, found.first) / some, np.log1p(longest), _sums(bare, found.first) / some, _sums(capital, found.first) / some]
    only_breaks = np.zeros(256, dtype=bool)
    only_breaks[10] = True
    rows = text.words(texts, only_breaks)
    columns.append(_distinct(rows.hashes, rows.first)[0] / np.maximum(np.diff(rows.first), 1))
    columns.append(commonest / some)
    return np.column_stack(columns)


@dataclass
class Trees:
    """Complete trees of one depth as arrays: node k has the children 2k + 1 and 2k + 2."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sum over the trees; all rows walk down a level at a time."""
        rows = np.arange(len(x))
        out = np.full(len(x), self.base)
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(int(np.log2(inner + 1))):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> Trees:
    """Boosted trees for log-loss.  Features are cut at quantiles into ``bins``; a level's split is found from one
    histogram of gradients for all its nodes and features.  Without rows of both classes the score is constant.
    """
    inner, leaves, width = (1 << depth) - 1, 1 << depth, x.shape[1]
    rate_of_ones = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    shape = (trees if 0 < y.sum() < len(y) else 0, inner)
    made = Trees(base, np.zeros(shape, np.int64), np.full(shape, np.inf), np.zeros((shape[0], leaves)))
    if not shape[0]:
        return made
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
    binned = np.column_stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T, strict=True)])
    offsets = np.arange(width) * bins
    margin = np.full(len(y), base)
    for t in range(shape[0]):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            nodes = 1 << level
            at = node - (nodes - 1)
            flat = (at[:, None] * (width * bins) + offsets + binned).ravel()
            sums = [np.bincount(flat, np.repeat(v, width), nodes * width * bins).reshape(nodes, width, bins) for v in (gradient, hessian)]
            g, h = (np.cumsum(s, axis=2) for s in sums)
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + L2) + (all_g - g) ** 2 / (all_h - h + L2) - all_g**2 / (all_h + L2)
            gain = np.where((h >= LEAST_WEIGHT) & (all_h - h >= LEAST_WEIGHT), gain, 0).reshape(nodes, -1)
            best = gain.argmax(axis=1)
            for k in np.flatnonzero(gain[np.arange(nodes), best] > 1e-6):
                feature, cut = divmod(int(best[k]), bins)
                made.feature[t, nodes - 1 + k] = feature
                made.threshold[t, nodes - 1 + k] = cuts[feature][cut] if cut < len(cuts[feature]) else np.inf
            node = 2 * node + 1 + (x[np.arange(len(y)), made.feature[t, node]] > made.threshold[t, node])
        leaf = node - inner
        weight = np.bincount(leaf, hessian, leaves) + L2
        made.value[t] = -rate * np.bincount(leaf, gradient, leaves) / weight
        margin += made.value[t][leaf]
    return made


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Label and statistics of batches of (_label, _text)."""
    for batch in batches:
        for first, end, some in text.slices(text.text_bytes(batch.column(1))):
            flat = statistics(some).ravel()
            lists = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, len(STATISTICS), dtype=np.int32), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), lists], ["label", "x"])


def train_quality(
    docs: DataFrame, labels: DataFrame, target: str = "quality", folds: int = 4, held_out: int = 2, rows: int = SAMPLE_ROWS
) -> Trees:
    """Trees fitted on ``rows`` labelled documents at most; only their statistics come to the driver."""
    sample = sample_texts(docs, labelled_sample(labels, target, folds, held_out, rows))
    # in one order, so that the sums and so the trees are the same every time
    got = sample.mapInArrow(_measured, "label int, x array<double>").orderBy("label", "x").toArrow()
    x = np.array(got["x"].to_pylist(), dtype=float).reshape(-1, len(STATISTICS))
    return fit(x, np.array(got["label"].to_pylist(), dtype=float))


def score_quality(docs: DataFrame, model: Trees) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1, higher: better) of every row, from the whole text.

    Null and empty texts have the score of zero statistics; null and repeated ids stay; a text much longer than a
    slice is measured alone, in memory in proportion to its length; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, some in text.slices(text.text_bytes(batch.column(1))):
                scores = pa.array(model.score(statistics(some)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), scores], ["doc_id", "score"])

    return docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, "doc_id bigint, score double")


def quality_query(documents: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_quality(documents, train_quality(documents, labels))
    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
