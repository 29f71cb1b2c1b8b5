"""Toxic spans by a linear-chain conditional random field.

Documents are labelled, tokens are not.  Tokens of toxic training documents are
labelled first by how much their features lean to toxic documents, then by the
marginals of the model itself; tokens of clean documents are clean.  The model
has a weight for every hashed feature of a token and for every pair of
neighbouring tags, and is trained by gradient ascent with exact marginals.

For two tags, forward and backward messages are one log ratio per token.  Both
recursions contract, so they are solved for all tokens of a batch at once by
repeating the step until nothing changes; a document of n tokens needs n
repetitions at most.

A document's score is a logistic function of its marginals, fitted on documents
that the field was not trained on.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.labelled import held_out, sample
from strata.llm.worker import held

BUCKETS = 1 << 18
SAMPLE_ROWS = 6000
EPOCHS = 24
RATE = 0.5
ROUNDS = 2
TOLERANCE = 1e-7

CACHED_WORDS = 200_000
BATCH_TOKENS = 200_000


def core(token: str) -> str:
    """A token's letters and digits without what surrounds them, in lower case."""
    start, end = 0, len(token)
    while start < end and not token[start].isalnum():
        start += 1
    while end > start and not token[end - 1].isalnum():
        end -= 1
    return token[start:end].lower()


def token_features(token: str) -> list[str]:
    """The word, its beginnings and end, its length, and beginnings with the length."""
    word = core(token)
    if not word:
        return ["mark"]
    size = min(len(word), 16)
    heads = [word[:n] for n in (3, 4, 5, 6, 7) if n < len(word)]
    return [
        "w:" + word,
        *["p:" + h for h in heads],
        *[f"l:{size}:{h}" for h in heads],
        "s:" + word[-3:],
        f"n:{size}",
    ]


def _bucket(feature: str) -> int:
    return xxhash.xxh3_64_intdigest(feature) % BUCKETS


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


@dataclass
class Field:
    weights: np.ndarray  # log odds of the toxic tag, by feature bucket
    pairs: np.ndarray  # potential of (tag before, tag), 2 x 2
    bias: float = 0.0

    def emission(self, token: str) -> float:
        return self.bias + float(sum(self.weights[_bucket(f)] for f in token_features(token)))


def _forward_step(x: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Log ratio that reaches the next token from log ratio ``x`` over its tags."""
    return np.logaddexp(pairs[0, 1], pairs[1, 1] + x) - np.logaddexp(pairs[0, 0], pairs[1, 0] + x)


def _solve(emissions: np.ndarray, edge: np.ndarray, pairs: np.ndarray, direction: int) -> np.ndarray:
    """Messages into every token from one side; zero where ``edge`` says that nothing comes."""
    step_pairs = pairs if direction > 0 else pairs.T
    message = np.zeros(len(emissions))
    while True:
        reached = _forward_step(emissions + message, step_pairs)
        arrived = np.zeros(len(emissions))
        if direction > 0:
            arrived[1:] = reached[:-1]
        else:
            arrived[:-1] = reached[1:]
        arrived[edge] = 0.0
        change = np.max(np.abs(arrived - message), initial=0.0)
        message = arrived
        if change < TOLERANCE:
            return message


def messages(emissions: np.ndarray, lengths: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log ratios of all tokens of several documents laid end to end."""
    ends = np.cumsum(lengths[lengths > 0])
    starts = np.append(0, ends[:-1]) if len(ends) else ends
    before = _solve(emissions, starts, pairs, 1)
    after = _solve(emissions, ends - 1, pairs, -1)
    return before, after


def marginals(emissions: np.ndarray, lengths: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Probability of the toxic tag of every token."""
    before, after = messages(emissions, lengths, pairs)
    return _sigmoid(emissions + before + after)


def _pair_expectations(emissions, lengths, pairs) -> tuple[np.ndarray, np.ndarray]:
    """Marginals, and expected counts of neighbouring tags."""
    before, after = messages(emissions, lengths, pairs)
    own = _sigmoid(emissions + before + after)
    inner = np.ones(len(emissions), bool)
    ends = np.cumsum(lengths[lengths > 0])
    inner[ends - 1] = False
    left = np.flatnonzero(inner)
    a, b = (emissions + before)[left], (emissions + after)[left + 1]
    logs = np.stack([np.full(len(left), pairs[0, 0]), pairs[0, 1] + b, pairs[1, 0] + a, pairs[1, 1] + a + b])
    logs -= logs.max(axis=0, initial=-np.inf) if len(left) else 0
    shares = np.exp(logs)
    shares /= shares.sum(axis=0)
    return own, shares.sum(axis=1).reshape(2, 2)


class _Corpus:
    """Training documents as numbers: distinct tokens, their features, and where they stand."""

    def __init__(self, rows: list[tuple[int, str, int]]):
        self.labels = np.array([label for _, _, label in rows], np.int64)
        place: dict[str, int] = {}
        found = []  # one document after another, so that only one is split at a time
        for _, text, _ in rows:
            found.append(np.array([place.setdefault(w, len(place)) for w in text.split()], np.int32))
        self.lengths = np.fromiter(map(len, found), np.int64, len(found))
        self.tokens = np.concatenate(found) if found else np.empty(0, np.int32)
        buckets, counts = array("i"), array("i")
        for word in place:
            own = [_bucket(f) for f in token_features(word)]
            buckets.extend(own)
            counts.append(len(own))
        self.buckets = np.frombuffer(buckets, np.int32) if buckets else np.empty(0, np.int32)
        self.counts = np.frombuffer(counts, np.int32) if counts else np.empty(0, np.int32)
        self.owner = np.repeat(np.arange(len(self.counts), dtype=np.int32), self.counts)
        self.document = np.repeat(np.arange(len(found), dtype=np.int32), self.lengths)

    def emissions(self, field: Field) -> np.ndarray:
        per_word = np.bincount(self.owner, weights=field.weights[self.buckets], minlength=len(self.counts))
        return field.bias + per_word[self.tokens]

    def leaning(self) -> np.ndarray:
        """For every distinct token the strongest lean of its features to toxic documents, in log odds."""
        first = np.cumsum(self.counts) - self.counts
        seen = np.zeros((2, BUCKETS), np.int64)  # clean and toxic documents that hold a feature
        for label, own in zip(self.labels, np.split(self.tokens, np.cumsum(self.lengths)[:-1])):
            words = np.unique(own)
            if len(words):
                n = self.counts[words]
                at = np.repeat(first[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                seen[label][np.unique(self.buckets[at])] += 1
        in_clean, in_toxic = seen
        n_toxic, n_clean = max(int((self.labels == 1).sum()), 1), max(int((self.labels == 0).sum()), 1)
        lean = np.log((in_toxic + 0.1) / n_toxic) - np.log((in_clean + 0.5) / n_clean)
        lean[in_toxic < 3] = -np.inf
        best = np.full(len(self.counts), -np.inf)
        np.maximum.at(best, self.owner, lean[self.buckets])
        return best


LEAN = 2.5


def train_field(rows: list[tuple[int, str, int]], epochs: int = EPOCHS, rounds: int = ROUNDS, rate: float = RATE) -> Field:
    """Gradient ascent (with per-weight rates) on token tags that start from leanings."""
    field = Field(np.zeros(BUCKETS), np.zeros((2, 2)), -4.0)
    corpus = _Corpus(rows)
    if not len(corpus.tokens) or len(set(corpus.labels.tolist())) < 2:
        return field
    in_toxic = corpus.labels[corpus.document] == 1
    tags = ((corpus.leaning()[corpus.tokens] > LEAN) & in_toxic).astype(np.float64)
    used = np.unique(corpus.buckets)
    squares, pair_squares, bias_square = np.full(BUCKETS, 1e-8), np.full((2, 2), 1e-8), 1e-8
    inner = np.ones(len(corpus.tokens), bool)
    inner[np.cumsum(corpus.lengths[corpus.lengths > 0]) - 1] = False
    left = np.flatnonzero(inner)
    for turn in range(rounds):
        if turn:
            own = marginals(corpus.emissions(field), corpus.lengths, field.pairs)
            tags = ((own > 0.5) & in_toxic).astype(np.float64)
        a, b = tags[left], tags[left + 1]
        observed = np.array([[((1 - a) * (1 - b)).sum(), ((1 - a) * b).sum()], [(a * (1 - b)).sum(), (a * b).sum()]])
        for _ in range(epochs // rounds):
            own, expected = _pair_expectations(corpus.emissions(field), corpus.lengths, field.pairs)
            wrong = np.bincount(corpus.tokens, weights=tags - own, minlength=len(corpus.counts))
            gradient = np.bincount(corpus.buckets, weights=wrong[corpus.owner], minlength=BUCKETS)
            gradient[used] -= 0.5 * field.weights[used]
            squares += gradient**2
            field.weights += rate * gradient / np.sqrt(squares)
            pull = observed - expected
            pair_squares += pull**2
            field.pairs += 0.5 * rate * pull / np.sqrt(pair_squares)
            total = float(wrong.sum())
            bias_square += total**2
            field.bias += 0.5 * rate * total / bias_square**0.5
    return field


SUMMARIES = 5


def summary(own: np.ndarray) -> np.ndarray:
    """What a document's score is made of, from its marginals."""
    if not len(own):
        return np.zeros(SUMMARIES)
    total = float(own.sum())
    return np.array([np.log1p(total), float(own.max()), total / len(own) * 10, float((own > 0.5).sum() >= 2), np.log1p(len(own)) / 10])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Newton's method; the last weight is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    weights = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(30):
        p = _sigmoid(x @ weights)
        slope = x.T @ (y - p) - penalty * weights
        bend = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        move = np.linalg.solve(bend, slope)
        weights += move
        if np.abs(move).max() < 1e-8:
            break
    return weights


@dataclass
class Model:
    field: Field
    weights: np.ndarray  # of the summaries and the intercept

    def score(self, summaries: np.ndarray) -> np.ndarray:
        return _sigmoid(summaries @ self.weights[:-1] + self.weights[-1])


def train(rows: list[tuple[int, str, int]]) -> Model:
    """Field on three quarters of the rows, document scores on the rest.

    With labels of one kind only, every score is the share of toxic rows.
    """
    labels = np.array([label for _, _, label in rows], np.float64)
    share = min(max(float(labels.mean()) if len(rows) else 0.5, 0.001), 0.999)
    constant = np.append(np.zeros(SUMMARIES), np.log(share / (1 - share)))
    if len(set(labels.tolist())) < 2:
        return Model(Field(np.zeros(BUCKETS), np.zeros((2, 2)), -4.0), constant)
    rest = [row for row in rows if xxhash.xxh3_64_intdigest(str(row[0])) % 4 == 0]
    most = [row for row in rows if xxhash.xxh3_64_intdigest(str(row[0])) % 4]
    if len({label for _, _, label in rest}) < 2 or len({label for _, _, label in most}) < 2:
        rest = most = rows
    # As many clean documents as three for each toxic one are enough for the field.
    toxic = [row for row in most if row[2]]
    clean = sorted((row for row in most if not row[2]), key=lambda row: xxhash.xxh3_64_intdigest(str(row[0])))
    field = train_field(toxic + clean[: 3 * len(toxic) + 100])
    summaries = Tagger(Model(field, constant)).summaries(text for _, text, _ in rest)
    return Model(field, _logistic(summaries, np.array([label for _, _, label in rest], np.float64)))


class Tagger:
    """Tags whole texts; one per worker."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, float] = {}

    def _marginals(self, documents: list[list[str]]) -> list[np.ndarray]:
        lengths = np.fromiter(map(len, documents), np.int64, len(documents))
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        for words in documents:
            for word in words:
                if word not in self.known:
                    self.known[word] = self.model.field.emission(word)
        look = self.known.__getitem__
        emissions = np.fromiter((look(w) for d in documents for w in d), np.float64, int(lengths.sum()))
        own = marginals(emissions, lengths, self.model.field.pairs)
        return np.split(own, np.cumsum(lengths)[:-1]) if len(documents) else []

    def tag(self, texts):
        """The marginals of every text's tokens."""
        waiting, n = [], 0
        for text in texts:
            waiting.append(text.split())
            n += len(waiting[-1])
            if n >= BATCH_TOKENS:
                yield from self._marginals(waiting)
                waiting, n = [], 0
        yield from self._marginals(waiting)

    def summaries(self, texts) -> np.ndarray:
        found = [summary(own) for own in self.tag(texts)]
        return np.array(found).reshape(len(found), SUMMARIES)


def spans(text: str, own: np.ndarray, least: float = 0.5) -> list[dict]:
    """Runs of tokens with marginals above ``least``: code points, and the largest marginal."""
    if not (own > least).any():
        return []
    found, at = [], 0
    joined = False
    for token, p in zip(text.split(), own):
        start = text.index(token, at)
        at = start + len(token)
        if p <= least:
            joined = False
        elif joined:
            found[-1] = {"start": found[-1]["start"], "end": at, "marginal": max(found[-1]["marginal"], float(p))}
        else:
            found.append({"start": start, "end": at, "marginal": float(p)})
            joined = True
    return found


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))
_SPANS_DDL = "array<struct<start:int,end:int,marginal:double>>"


def tagged(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``toxicity`` (0 to 1) and ``toxic_spans`` to every row of ``docs``.

    Only ``text`` is read; a null text is scored as an empty one and has no
    spans.  Columns of these names are replaced.
    """
    docs = docs.drop("toxicity", "toxic_spans")
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        model = shared.value
        tagger = held("toxicity", model, lambda: Tagger(model))
        for batch in batches:
            column = batch.column("text")
            summaries, found = [], []
            for value, own in zip(column, tagger.tag(v.as_py() or "" for v in column)):
                summaries.append(summary(own))
                found.append(spans(value.as_py() or "", own))
            scores = tagger.model.score(np.array(summaries).reshape(len(summaries), SUMMARIES))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64()), pa.array(found, _SPANS)], [*names, "toxicity", "toxic_spans"]
            )

    extra = [F.lit(0.0).alias("toxicity"), F.lit(None).cast(_SPANS_DDL).alias("toxic_spans")]
    return docs.mapInArrow(scored, docs.select("*", *extra).schema)


def predictions(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Toxicity of every row of ``docs``: doc_id, held_out, score, predicted, toxic_spans.

    Trained on at most ``rows`` labelled rows outside the held-out fold.  Null and
    empty texts get the score of a text without tokens and no spans; rows that
    repeat are judged alike; a null doc_id is held out.  Other columns are not
    read, an empty table gives no rows.
    """
    model = train(sample(docs, labels, "toxic", rows))
    scored = tagged(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
        "toxic_spans",
    )
