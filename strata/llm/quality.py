"""Quality classifier: supervised subword embeddings.

Every word has the vectors of its hashed spelling and of its hashed character
n-grams; their mean over a document goes through a softmax.  Vectors and output
weights are learned together by stochastic gradient descent on a bounded sample
of labelled documents.  Scoring sends the vectors to the tasks once; a worker
keeps the sums of a bounded number of words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.labelled import SAMPLE_ROWS, held_out, sample
from strata.llm.worker import held

BUCKETS = 1 << 16
DIMENSIONS = 16
GRAMS = (3, 4)
EPOCHS = 6
RATE = 0.4
KEEP_SCORE = 0.3

CACHED_WORDS = 150_000
BATCH_WORDS = 200_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
# A word that is the same as the one before it adds this feature.
_SAME = 0


def _buckets(hashes: np.ndarray) -> np.ndarray:
    """Bucket 0 stays free for the feature of repeated words."""
    return (1 + (hashes ^ (hashes >> np.uint64(31))) * _ODD % np.uint64(BUCKETS - 1)).astype(np.int64)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of ``words``, word by word, and how many each word has.

    A word's features are the whole word and its character n-grams, with marks
    for its start and its end.
    """
    marked = ["\x02" + w + "\x03" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(words)), lengths)
    last = ends[owner]
    place = np.arange(len(codes))
    within = (place - (last - lengths[owner])).astype(np.uint64)

    def scrambled(values):
        values = values * _ODD
        return values ^ (values >> np.uint64(32))

    whole = np.add.reduceat(scrambled(scrambled(codes + np.uint64(1)) + within), ends - lengths)
    found, owners = [whole], [np.arange(len(words))]
    for n in GRAMS:
        size = len(codes) - n + 1
        if size <= 0:
            continue
        total = np.full(size, n, np.uint64)
        for i in range(n):
            total = scrambled(total ^ codes[i : i + size]) + np.uint64(i)
        inside = place[:size] + n <= last[:size]
        found.append(total[inside])
        owners.append(owner[:size][inside])
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return _buckets(np.concatenate(found))[order], np.bincount(owners, minlength=len(words))


@dataclass
class Model:
    vectors: np.ndarray  # one per bucket
    weights: np.ndarray  # of the softmax, for label 1 against 0
    bias: float

    def score(self, means: np.ndarray) -> np.ndarray:
        """Probability of label 1 for means of vectors."""
        return 1.0 / (1.0 + np.exp(-np.clip(means @ self.weights + self.bias, -40, 40)))


def _document(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature buckets of a text and their shares."""
    words = text.split()
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.float32)
    spelling, place, times = np.unique(np.array(words, dtype=object), return_inverse=True, return_counts=True)
    buckets, counts = features(spelling.tolist())
    weight = np.repeat(times, counts).astype(np.float64)
    same = int((place[1:] == place[:-1]).sum())
    buckets, weight = np.append(buckets, _SAME), np.append(weight, same)
    distinct, where = np.unique(buckets, return_inverse=True)
    shares = np.bincount(where, weights=weight)
    return distinct, (shares / shares.sum()).astype(np.float32)


def train(
    rows: list[tuple[int, str, int]], dimensions: int = DIMENSIONS, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7
) -> Model:
    """Stochastic gradient descent over (doc_id, text, label); a sample of one class gives a constant."""
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((BUCKETS, dimensions)) - 0.5) / dimensions).astype(np.float32)
    share = np.mean([label for _, _, label in rows]) if rows else 0.5
    share = min(max(float(share), 0.01), 0.99)
    model = Model(vectors, np.zeros(dimensions, np.float32), float(np.log(share / (1 - share))))
    if not rows or len({label for _, _, label in rows}) < 2:
        return model
    documents = [(*_document(text), label) for _, text, label in rows]
    weights = rng.normal(0, 1.0, dimensions).astype(np.float32)
    bias, steps, step = model.bias, epochs * len(documents), 0
    for _ in range(epochs):
        for i in rng.permutation(len(documents)):
            now = rate * (1 - step / steps)
            step += 1
            buckets, shares, label = documents[i]
            if not len(buckets):
                bias += 0.1 * now * (label - 1 / (1 + np.exp(-bias)))
                continue
            mean = shares @ vectors[buckets]
            wrong = label - 1 / (1 + np.exp(-np.clip(mean @ weights + bias, -40, 40)))
            # Shares are small, so the step of a vector is taken per document length of shares.
            vectors[buckets] += (now * wrong / np.dot(shares, shares) ** 0.5) * np.outer(shares, weights)
            weights += now * wrong * mean
            bias += 0.1 * now * wrong
    return Model(vectors, weights, float(bias))


class Scorer:
    """Scores whole texts; one per worker."""

    def __init__(self, model: Model):
        self.model = model
        self.place: dict[str, int] = {}
        self.sums = np.zeros((1024, model.vectors.shape[1] + 1), np.float32)

    def _learn(self, words: list[str]) -> None:
        for start in range(0, len(words), 20_000):
            part = words[start : start + 20_000]
            buckets, counts = features(part)
            sums = np.add.reduceat(self.model.vectors[buckets], np.cumsum(counts) - counts, axis=0)
            first = len(self.place)
            while first + len(part) > len(self.sums):
                self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
            self.sums[first : first + len(part), :-1] = sums
            self.sums[first : first + len(part), -1] = counts
            self.place.update(zip(part, range(first, first + len(part))))

    def _score(self, documents: list[list[str]]) -> np.ndarray:
        lengths = np.fromiter(map(len, documents), np.int64, len(documents))
        words = [w for d in documents for w in d]
        if len(self.place) > CACHED_WORDS:
            self.place.clear()
        unseen = list({w for w in words if w not in self.place})
        if unseen:
            self._learn(unseen)
        places = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        totals = np.zeros((len(documents), self.sums.shape[1]), np.float64)
        filled = lengths > 0
        if len(places):
            totals[filled] = np.add.reduceat(self.sums[places], (ends - lengths)[filled], axis=0)
            same = np.append(False, places[1:] == places[:-1])
            same[(ends - lengths)[filled]] = False
            repeats = np.add.reduceat(same.astype(np.int64), (ends - lengths)[filled])
            totals[filled, :-1] += repeats[:, None] * self.model.vectors[_SAME]
            totals[filled, -1] += repeats
        means = totals[:, :-1] / np.maximum(totals[:, -1:], 1)
        return self.model.score(means)

    def scores(self, texts) -> np.ndarray:
        found, waiting, n = [np.empty(0)], [], 0
        for text in texts:
            waiting.append(text.split())
            n += len(waiting[-1])
            if n >= BATCH_WORDS:
                found.append(self._score(waiting))
                waiting, n = [], 0
        if waiting:
            found.append(self._score(waiting))
        return np.concatenate(found)


def with_scores(docs: DataFrame, model: Model, into: str = "quality_score") -> DataFrame:
    """Add the probability of label 1 to every row; a null text is scored as an empty one.

    Only ``text`` is read.  A column named ``into`` is replaced.
    """
    docs = docs.drop(into)
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        model = shared.value
        own = held("quality", model, lambda: Scorer(model))
        for batch in batches:
            values = own.scores(v.as_py() or "" for v in batch.column("text"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], [*names, into])

    return docs.mapInArrow(scored, docs.select("*", F.lit(0.0).alias(into)).schema)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> Model:
    """Train on at most ``rows`` labelled documents outside the held-out fold."""
    return train(sample(docs, labels, label, rows))


def predictions(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Quality of every row of ``docs``: doc_id, held_out, score, predicted.

    Null and empty texts get the score of a document without words.  Repeated
    rows get the same score.  Without labels of both kinds the score is the share
    of the kind there is.
    """
    model = fit(docs, labels, "quality", rows)
    scored = with_scores(docs.select("doc_id", "text"), model, "score")
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= KEEP_SCORE).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, least: float = KEEP_SCORE, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``least``, with all their columns.

    Null and empty texts have the score of a document without words; rows that
    repeat stay or go together; an empty table stays empty.  The name ``__quality``
    is used here.
    """
    scored = with_scores(docs, fit(docs, labels, "quality", rows), "__quality")
    return scored.where(F.col("__quality") >= least).select(*docs.columns)
