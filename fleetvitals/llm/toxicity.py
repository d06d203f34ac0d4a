"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posteriors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetvitals.llm import text
from fleetvitals.llm.labels import SAMPLE_ROWS, fold, labelled_sample, sample_texts
from fleetvitals.plans import durable

# Word beginnings of these lengths in bytes: stems whatever their endings.
PREFIXES = (4, 5, 6, 7, 8, 9)
# Characters in a row, anywhere in a run of characters of three bytes or more (scripts without spaces).
RUNS = (1, 2, 3, 4)
# Terms that are voters of their own, strongest first; the others vote in bands.
VOTERS = 150
_WORD, _FIRST, _SECOND = text.numbers(4, 3)
# Share of a term's texts that must be toxic, and the chance of so many at random: one in twenty for a million terms.
PURITY = 0.92
CHANCE = 5e-8
THRESHOLD = 0.7


def _terms(texts: text.Texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of terms, as signed numbers, and the text each is in, kind by kind: word beginnings, whole words of any
    length, adjacent words, characters in a row of scripts without spaces."""
    found = text.words(texts, text.NO_LETTER, PREFIXES)
    owner = np.repeat(np.arange(len(texts)), np.diff(found.first))
    for heads in found.prefixes:
        yield heads[heads != 0].view(np.int64), owner[heads != 0]
    yield text.mix64(found.hashes ^ _WORD).view(np.int64), owner
    if len(owner) > 1:
        one = owner[1:] == owner[:-1]
        pairs = text.mix64(found.hashes[:-1] ^ _FIRST) + text.mix64(found.hashes[1:] ^ _SECOND)
        yield text.mix64(pairs[one]).view(np.int64), owner[1:][one]
    for hashes, owner in text.runs(texts, RUNS):
        yield hashes.view(np.int64), owner


def _pairs(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (text, term) once."""
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[new], o[new]


def _term_counts(known: np.ndarray | None = None):
    """Texts that have a term, all or those of ``known``, summed within a slice, from batches of (_label, _text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, some in text.slices(text.text_bytes(batch.column(1))):
                if known is None:
                    hashes, owner = _pairs(*(np.concatenate(side) for side in zip(*_terms(some), strict=True)))
                else:
                    hashes, owner = Lexicon(known, known).hits(some)
                terms, counts = np.unique(hashes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), pa.array(counts, pa.int64())], ["term", "n"])

    return run


@dataclass
class Lexicon:
    """Term hashes in order, each with its place by weight of evidence."""

    terms: np.ndarray
    place: np.ndarray

    def hits(self, texts: text.Texts) -> tuple[np.ndarray, np.ndarray]:
        """(place of term, text) for each term of the lexicon in each text, once."""
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sieve = np.zeros(1 << 16, dtype=bool)
        sieve[self.terms & 0xFFFF] = True
        places, owners = [], []
        for hashes, owner in _terms(texts):
            maybe = sieve[hashes & 0xFFFF]
            hashes, owner = hashes[maybe], owner[maybe]
            at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
            real = self.terms[at] == hashes
            places.append(self.place[at[real]])
            owners.append(owner[real])
        return _pairs(np.concatenate(places), np.concatenate(owners))


def mine_lexicon(sample: DataFrame) -> Lexicon:
    """Terms found in toxic texts far more than chance allows, strongest first.

    With a share s of toxic texts, a term in n texts of which k are toxic is kept if exp(-n KL(k/n, s)), which bounds
    the chance of so many, is below ``CHANCE``, and if ``PURITY`` of its texts are toxic.  Nothing else bounds the lexicon.
    """
    share = sample.agg(F.coalesce(F.avg("_label"), F.lit(0.0)).alias("s")).first()["s"]
    if not 0 < share < 1:
        return Lexicon(np.zeros(0, np.int64), np.zeros(0, np.int64))
    schema = "term bigint, n bigint"
    toxic = sample.where("_label = 1").mapInArrow(_term_counts(), schema).groupBy("term").agg(F.sum("n").alias("k"))
    least = float(np.log(CHANCE) / np.log(share))
    candidates = durable(toxic.where(F.col("k") >= least))
    known = np.sort(candidates.select("term").toArrow()["term"].to_numpy())
    clean = sample.where("_label = 0").mapInArrow(_term_counts(known), schema).groupBy("term").agg(F.sum("n").alias("c"))
    counted = candidates.join(clean, "term", "left").withColumn("c", F.coalesce("c", F.lit(0)).cast("double"))
    k, c, n = F.col("k").cast("double"), F.col("c"), F.col("k") + F.col("c")
    evidence = k * F.log(k / (n * share)) + F.when(c > 0, c * F.log(c / (n * (1 - share)))).otherwise(0.0)
    strong = counted.where((k >= PURITY * n) & (evidence > -float(np.log(CHANCE))))
    hashes = strong.orderBy(evidence.desc(), "term").select("term").toArrow()["term"].to_numpy()
    order = np.argsort(hashes)
    return Lexicon(hashes[order], order)


class LabelModel:
    """A generative model of votes: y is drawn, then every voter votes or abstains with a chance that depends on y.

    Accuracies are those chances, found by expectation maximisation.  Correlations are those of the residuals of
    two voters once y is known; a voter's evidence counts 1 / (1 + its correlations), so nested and copied voters
    count about once.
    """

    def __init__(self, votes: np.ndarray, start: np.ndarray, rounds: int = 25):
        """``votes``: texts x voters, 1 or 0; ``start``: first guess of P(y = 1)."""
        posterior = np.clip(start.astype(float), 0.02, 0.98)
        for _ in range(rounds):
            weight = np.column_stack([1 - posterior, posterior])
            self.prior = (weight.sum(0) + 1) / (len(votes) + 2)
            self.chance = (weight.T @ votes + 0.1) / (weight.sum(0)[:, None] + 0.2 + 0.8 * (votes.shape[1] > 0))
            residual = votes - weight @ self.chance
            spread = np.sqrt((residual**2).sum(0) + 1e-9)
            self.correlation = (residual.T @ residual) / np.outer(spread, spread)
            np.fill_diagonal(self.correlation, 0)
            self.share = 1 / (1 + np.maximum(self.correlation, 0).sum(0))
            posterior = self.posterior(votes)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        given = np.log(self.chance[1] / self.chance[0])
        silent = np.log((1 - self.chance[1]) / (1 - self.chance[0]))
        logit = np.log(self.prior[1] / self.prior[0]) + votes @ (self.share * given) + (1 - votes) @ (self.share * silent)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _voters(row: np.ndarray, place: np.ndarray, texts: int, terms: int) -> np.ndarray:
    """Votes from the terms that texts have: single terms, bands of the lexicon, numbers of hits, and none at all."""
    many = np.bincount(row, minlength=texts)
    single = np.zeros((texts, min(VOTERS, terms)), dtype=bool)
    single[row[place < VOTERS], place[place < VOTERS]] = True
    bands = np.zeros((texts, 8), dtype=bool)
    bands[row, place % 8] = True
    patterns = [many >= 1, many >= 2, many >= 4, many == 0]
    return np.column_stack([single, bands, *patterns]).astype(float)


def _logistic(row: np.ndarray, place: np.ndarray, terms: int, y: np.ndarray, l2: float = 1.0, rounds: int = 300) -> tuple[float, np.ndarray]:
    """Ridge logistic regression on soft labels, by accelerated gradient steps; the last weight is that of any term."""
    # the places of ones in the matrix of a constant, the terms, and whether there is any
    some = np.unique(row)
    at = np.concatenate([np.arange(len(y)), row, some])
    column = np.concatenate([np.zeros(len(y), np.int64), place + 1, np.full(len(some), terms + 1)])

    def times(w: np.ndarray) -> np.ndarray:
        return np.bincount(at, w[column], len(y))

    def back(r: np.ndarray) -> np.ndarray:
        return np.bincount(column, r[at], terms + 2)

    # the greatest singular value squared, by power iteration from a positive vector
    v = np.ones(terms + 2)
    for _ in range(50):
        v = back(times(v))
        largest = np.linalg.norm(v)
        v /= largest
    step = 1 / (0.25 * 1.05 * largest + l2)
    penalty = np.full(terms + 2, l2)
    penalty[0] = 0
    w = ahead = np.zeros(terms + 2)
    for i in range(rounds):
        gradient = back(1 / (1 + np.exp(-np.clip(times(ahead), -30, 30))) - y) + penalty * ahead
        new = ahead - step * gradient
        ahead, w = new + i / (i + 3) * (new - w), new
    return float(w[0]), w[1:]


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    bias: float
    weights: np.ndarray

    def score(self, texts: text.Texts) -> np.ndarray:
        place, owner = self.lexicon.hits(texts)
        many = np.bincount(owner, minlength=len(texts))
        margin = self.bias + np.bincount(owner, self.weights[place], len(texts)) if len(place) else np.full(len(texts), self.bias)
        return 1 / (1 + np.exp(-np.clip(margin + np.where(many > 0, self.weights[-1], 0), -30, 30)))


def train_toxicity(
    docs: DataFrame, labels: DataFrame, target: str = "toxic", folds: int = 3, held_out: int = 1, rows: int = SAMPLE_ROWS
) -> ToxicityModel:
    """A model fitted on ``rows`` labelled documents at most.

    Labels serve to find the lexicon, as the label model's first guess and as one voter; the classifier learns the posteriors.
    The driver gets the hashes of the lexicon and for each sampled text the terms it has.
    """
    sample = sample_texts(docs, labelled_sample(labels, target, folds, held_out, rows))
    lexicon = mine_lexicon(sample)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, some in text.slices(text.text_bytes(batch.column(1))):
                place, owner = lexicon.hits(some)
                bounds = np.searchsorted(owner, np.arange(end - first + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.ListArray.from_arrays(bounds, place)], ["label", "places"]
                )

    got = sample.mapInArrow(marked, "label int, places array<bigint>").orderBy("label", "places").toArrow()
    y = np.array(got["label"].to_pylist(), dtype=float)
    places = got["places"].combine_chunks()
    row, place = np.repeat(np.arange(len(y)), places.value_lengths().to_numpy()), places.flatten().to_numpy()
    if not len(lexicon.terms):
        rate = (y.sum() + 1) / (len(y) + 20)
        return ToxicityModel(lexicon, float(np.log(rate / (1 - rate))), np.zeros(1))
    # the label that a person gave is one more voter, whose accuracy is estimated like the others'
    votes = np.column_stack([_voters(row, place, len(y), len(lexicon.terms)), y])
    posterior = LabelModel(votes, y).posterior(votes)
    bias, weights = _logistic(row, place, len(lexicon.terms), posterior)
    return ToxicityModel(lexicon, bias, weights)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1, higher: toxic likelier) of every row, from the whole text.

    Null and empty texts have the score of a text without lexicon terms; null and repeated ids stay; a very long
    text is read alone, in memory in proportion to its length; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, some in text.slices(text.text_bytes(batch.column(1))):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(model.score(some))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, "doc_id bigint, score double")


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold; columns as given, row by row, without a join."""
    names = docs.columns
    # the text goes to Python once, inside its row
    packed = docs.select(F.struct(*(F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names))).alias("_row"))
    schema, at = packed.schema, names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, some in text.slices(text.text_bytes(batch.column(0).field(at))):
                clean = pa.array(model.score(some) < threshold)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first).filter(clean)], ["_row"])

    return packed.mapInArrow(run, schema).select(*(F.col(f"_row.c{i}").alias(n) for i, n in enumerate(names)))


def toxicity_query(documents: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_toxicity(documents, train_toxicity(documents, labels))
    held_out = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
