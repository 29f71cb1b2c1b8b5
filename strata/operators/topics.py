"""Vocabulary, LDA and NMF topic models, and their tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline
from pyspark.ml.clustering import LDA, LocalLDAModel
from pyspark.ml.feature import (
    IDF,
    PCA,
    CountVectorizer,
    CountVectorizerModel,
    StopWordsRemover,
    Tokenizer,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.storagelevel import StorageLevel

from strata.functions import vectors as V
from strata.operators import clean

# --- features ----------------------------------------------------------------------


def _term_counts(batches):
    """Rows (term, occurrences, rows that have it) of each batch."""
    for batch in batches:
        lists = batch.column(0)
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        coded = lists.flatten().dictionary_encode(null_encoding="encode")
        code, size = coded.indices.to_numpy(zero_copy_only=False), max(1, len(coded.dictionary))
        held = np.unique(np.repeat(np.arange(len(lists)), lengths) * size + code) % size
        counts = [pa.array(np.bincount(c, minlength=len(coded.dictionary))) for c in (code, held)]
        yield pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.string()), *counts], ["term", "n", "df"])


def fit_vocabulary(
    docs: DataFrame,
    tokens: str = "tokens_phrased",
    size: int = 20_000,
    min_df: float = 50,
    max_df: float = 0.2,
) -> CountVectorizerModel:
    """Vocabulary of at most ``size`` terms, the most frequent first, ties by the term.

    Document-frequency bounds of 1 and above are counts, smaller ones are shares
    of the documents.  ``size`` bounds what reaches the driver."""
    n_docs = docs.count() if min_df < 1 or max_df < 1 else 0
    low, high = (bound if bound >= 1 else bound * n_docs for bound in (min_df, max_df))
    counted = docs.select(tokens).mapInArrow(_term_counts, "term string, n bigint, df bigint")
    terms = counted.where(F.col("term").isNotNull()).groupBy("term").agg(F.sum("n").alias("count"), F.sum("df").alias("df"))
    best = terms.where(F.col("df").between(low, high)).orderBy(F.desc("count"), "term").limit(size)
    return CountVectorizerModel.from_vocabulary([r["term"] for r in best.collect()], tokens, "features")


def vectorise(docs: DataFrame, vocabulary: CountVectorizerModel) -> DataFrame:
    """Add ``features`` and ``vocab_hits``, the number of known tokens."""
    out = vocabulary.transform(docs)
    # The model makes sparse vectors: only their non-zero cells are summed.
    return out.withColumn("vocab_hits", V.total(F.unwrap_udt("features")["values"]))


def vocabulary_table(vocabulary: CountVectorizerModel, spark) -> DataFrame:
    """``term_id, term``; the vocabulary is bounded by its size parameter."""
    rows = list(enumerate(vocabulary.vocabulary))
    return spark.createDataFrame(rows, "term_id int, term string")


# --- LDA ----------------------------------------------------------------------------


def online_lda(
    k: int,
    max_iter: int = 10,
    seed: int = 42,
    learning_offset: float = 1024.0,
    learning_decay: float = 0.51,
    subsampling_rate: float = 0.05,
    optimize_alpha: bool = True,
) -> LDA:
    return LDA(
        k=k,
        maxIter=max_iter,
        seed=seed,
        optimizer="online",
        featuresCol="features",
        learningOffset=learning_offset,
        learningDecay=learning_decay,
        subsamplingRate=subsampling_rate,
        optimizeDocConcentration=optimize_alpha,
    )


def training_rows(features: DataFrame, keys: list[str], partitions: int | None = None) -> DataFrame:
    """Rows in an order that depends on the keys only, so that mini-batches repeat."""
    spark = features.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return features.select(*keys, "features").repartition(n, *keys).sortWithinPartitions(*keys)


def fit_each(
    features: DataFrame, keys: list[str], ks: list[int], done: set[int] | None = None, **params
) -> Iterator[tuple[int, LocalLDAModel]]:
    """One model per topic count that is not done yet, over one cached matrix, as each is ready."""
    todo = [k for k in ks if k not in (done or set())]
    if not todo:
        return
    rows = training_rows(features, keys).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        lda = online_lda(k=todo[0], **params)
        for at, model in lda.fitMultiple(rows, [{lda.k: k} for k in todo]):
            yield todo[at], model
    finally:
        rows.unpersist()


def fit_sweep(
    features: DataFrame, keys: list[str], ks: list[int], done: set[int] | None = None, **params
) -> dict[int, LocalLDAModel]:
    """All models of :func:`fit_each`."""
    return dict(fit_each(features, keys, ks, done, **params))


def fit_lda(features: DataFrame, keys: list[str], k: int, **params) -> LocalLDAModel:
    return fit_sweep(features, keys, [k], **params)[k]


def infer(model: LocalLDAModel, features: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, vocab_hits, highest_topic, theta``; no dominant topic for an empty bag."""
    scored = model.setFeaturesCol("features").transform(features)
    return scored.select(
        *keys, "vocab_hits", vector_to_array("topicDistribution").alias("theta")
    ).select(*keys, "vocab_hits", V.dominant(F.col("theta"), F.col("vocab_hits")).alias("highest_topic"), "theta")


def topic_words(model: LocalLDAModel, vocabulary: DataFrame, n: int = 100) -> DataFrame:
    """``topic, pos (from 0), word, weight`` of the first ``n`` words of every topic."""
    rows = model.describeTopics(n).select(
        "topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("pos", "t")
    )
    return rows.join(
        F.broadcast(vocabulary), F.col("t.termIndices") == vocabulary["term_id"]
    ).select("topic", "pos", F.col("term").alias("word"), F.col("t.termWeights").alias("weight"))


def probe_convergence(
    features: DataFrame,
    keys: list[str],
    k: int,
    iterations: list[int],
    offsets: list[float],
    holdout: float = 0.1,
    sample: float = 1.0,
    seed: int = 42,
    **params,
) -> DataFrame:
    """Held-out log-perplexity and log-likelihood over a grid of training settings."""
    spark = features.sparkSession
    rows = features if sample >= 1.0 else clean.hash_sample(features, keys, sample, seed)
    train, held = clean.holdout_split(rows, keys, holdout, seed + 1)
    train = training_rows(train, keys).persist(StorageLevel.MEMORY_AND_DISK)
    held = held.select(*keys, "features").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n_train, n_held = train.count(), held.count()
        lda = online_lda(k=k, seed=seed, **params)
        grid = [(o, i) for o in offsets for i in iterations]
        maps = [{lda.learningOffset: float(o), lda.maxIter: int(i)} for o, i in grid]
        cells = []
        for at, model in lda.fitMultiple(train, maps):
            offset, iters = grid[at]
            cells.append(
                (
                    k,
                    int(iters),
                    float(offset),
                    float(lda.getLearningDecay()),
                    float(lda.getSubsamplingRate()),
                    n_train,
                    n_held,
                    float(model.logPerplexity(held)),
                    float(model.logLikelihood(held)),
                )
            )
    finally:
        train.unpersist()
        held.unpersist()
    return spark.createDataFrame(
        cells,
        "k int, max_iter int, learning_offset double, learning_decay double, subsampling_rate double,"
        " train_n long, holdout_n long, log_perplexity double, log_likelihood double",
    )


def baseline_pipeline(
    k: int, max_iter: int = 10, size: int = 20_000, min_df: float = 1.0, language: str = "french", seed: int = 42
) -> Pipeline:
    """White-space tokens, default stop words, counts, EM topic model."""
    stop = StopWordsRemover.loadDefaultStopWords(language)
    return Pipeline(
        stages=[
            Tokenizer(inputCol="contents", outputCol="words"),
            StopWordsRemover(inputCol="words", outputCol="kept", stopWords=stop),
            CountVectorizer(inputCol="kept", outputCol="features", vocabSize=size, minDF=min_df),
            LDA(k=k, maxIter=max_iter, optimizer="em", seed=seed, checkpointInterval=5),
        ]
    )


# --- NMF -------------------------------------------------------------------------------


def fit_tfidf(docs: DataFrame, tokens: str, size: int = 20_000, min_df: float = 1.0):
    """Counting and weighting stages for TF-IDF features."""
    return Pipeline(
        stages=[
            CountVectorizer(inputCol=tokens, outputCol="counts", vocabSize=size, minDF=min_df),
            IDF(inputCol="counts", outputCol="features"),
        ]
    ).fit(docs)


def sparse_rows(df: DataFrame, keys: list[str], column: str = "features") -> DataFrame:
    """Indices and L2-normalised values of the non-zero cells of a vector column."""
    vector = F.unwrap_udt(column)
    # Sparse vectors list their cells; dense ones are numbered first.
    places = F.coalesce(vector["indices"], F.transform(vector["values"], lambda _, i: i))
    cells = F.filter(F.arrays_zip(places.alias("i"), vector["values"].alias("x")), lambda c: c["x"] != 0)

    def scaled(v):
        return F.struct(v["c"]["i"].alias("idx"), F.transform(v["c"]["x"], lambda x: x / v["size"]).alias("val"))

    def sized(c):
        return V.let(F.struct(c.alias("c"), F.greatest(V.norm(c["x"]), F.lit(1e-12)).alias("size")), scaled)

    # The length is bound to a name: as a column it would move into the lambda, and be summed again for every cell.
    return df.select(*keys, V.let(cells, sized).alias("r")).select(*keys, "r.idx", "r.val")


# Rows whose weights are solved side by side.
SOLVED = 1024


def _solved(idx: pa.ListArray, val: pa.ListArray, h: np.ndarray, gram: np.ndarray, steps: int):
    """Non-negative weights of the rows of a batch for a fixed matrix, some rows at a time:
    row of every cell, its term and value, weights, and products with the matrix."""
    for first in range(0, len(idx), SOLVED):
        some = idx.slice(first, SOLVED)
        n, at = len(some), some.flatten().to_numpy()
        x = val.slice(first, SOLVED).flatten().to_numpy()
        row = np.repeat(np.arange(n), np.diff(some.offsets.to_numpy()))
        target = np.stack([np.bincount(row, topic[at] * x, n) for topic in h], axis=1)
        w = np.full(target.shape, 1.0 / len(h))
        for _ in range(steps):
            w *= target / (w @ gram + 1e-12)
        yield row, at, x, w, target


def fit_nmf(rows: DataFrame, k: int, n_terms: int, iterations: int = 20, steps: int = 20, seed: int = 42):
    """Topic-term matrix (k by n_terms) of non-negative weights.

    Each round is one Spark job: tasks solve their rows, many side by side, for the current matrix
    and return the sums that its update needs, reduced per term.  The matrix is
    bounded by ``k`` times the vocabulary size and is shipped with the task.
    """
    spark = rows.sparkSession
    rng = np.random.default_rng(seed)
    h = rng.random((k, n_terms)) + 1e-3
    names = [f"c{i}" for i in range(k)]
    schema = "id int, " + ", ".join(f"{n} double" for n in names)
    cells = rows.select("idx", "val").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for _ in range(iterations):
            shared = spark.sparkContext.broadcast(h)

            def partial_sums(batches):
                matrix = shared.value
                gram = matrix @ matrix.T
                top = np.zeros_like(matrix)
                square = np.zeros((k, k))
                for batch in batches:
                    for row, at, x, w, _ in _solved(batch.column("idx"), batch.column("val"), matrix, gram, steps):
                        for topic in range(k):
                            top[topic] += np.bincount(at, w[row, topic] * x, n_terms)
                        square += w.T @ w
                used = np.flatnonzero(top.any(axis=0))
                ids = np.concatenate([used, -1 - np.arange(k)])
                block = np.concatenate([top[:, used].T, square])
                columns = [pa.array(ids.astype(np.int32)), *[pa.array(c.copy()) for c in block.T]]
                yield pa.RecordBatch.from_arrays(columns, ["id", *names])

            sums = cells.mapInArrow(partial_sums, schema).groupBy("id").agg(
                *[F.sum(n).alias(n) for n in names]
            )
            top, square = np.zeros_like(h), np.zeros((k, k))
            for row in sums.collect():  # at most n_terms + k rows
                if row[0] >= 0:
                    top[:, row[0]] = row[1:]
                else:
                    square[-1 - row[0]] = row[1:]
            h = h * top / (square @ h + 1e-12)
            shared.unpersist()
    finally:
        cells.unpersist()
    return h


def infer_nmf(rows: DataFrame, keys: list[str], h, steps: int = 50) -> DataFrame:
    """``keys, highest_topic, theta, error``: row weights for a fitted matrix,
    with the squared reconstruction error of the row."""
    shared = rows.sparkSession.sparkContext.broadcast(np.asarray(h))
    told = StructType([*[rows.schema[c] for c in keys], *StructType.fromDDL("theta array<double>, error double").fields])
    schema = to_arrow_schema(told)

    def solve(batches):
        matrix = shared.value
        gram = matrix @ matrix.T
        for batch in batches:
            first = 0
            for row, _, x, w, target in _solved(batch.column("idx"), batch.column("val"), matrix, gram, steps):
                errors = np.bincount(row, x * x, len(w)) - 2 * (w * target).sum(axis=1) + ((w @ gram) * w).sum(axis=1)
                ends = pa.array(np.arange(len(w) + 1, dtype=np.int32) * len(matrix))
                theta = pa.ListArray.from_arrays(ends, pa.array(w.ravel()), type=schema.field("theta").type)
                held = [batch.column(c).slice(first, len(w)) for c in keys]
                yield pa.RecordBatch.from_arrays([*held, theta, pa.array(errors)], schema=schema)
                first += len(w)

    solved = rows.select(*keys, "idx", "val").mapInArrow(solve, told)
    hits = F.aggregate("theta", F.lit(0.0), lambda a, x: a + x)
    return solved.select(*keys, V.dominant(F.col("theta"), hits).alias("highest_topic"), "theta", "error")


def matrix_words(h, vocabulary: list[str], spark, n: int = 99) -> DataFrame:
    """``topic, pos, word, weight`` of the first ``n`` words of every matrix row."""
    rows = []
    for topic, weights in enumerate(np.asarray(h)):
        for pos, at in enumerate(np.argsort(-weights, kind="stable")[:n]):
            rows.append((topic, pos, vocabulary[at], float(weights[at])))
    return spark.createDataFrame(rows, "topic int, pos int, word string, weight double")


# --- projections ---------------------------------------------------------------------------


def project_pca(topics: DataFrame, keys: list[str], theta: str = "theta", dims: int = 2) -> DataFrame:
    """Principal-component coordinates of centred topic vectors."""
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector

    rows = topics.select(*keys, array_to_vector(theta).alias("__v"))
    stages = [
        StandardScaler(inputCol="__v", outputCol="__c", withMean=True, withStd=False),
        PCA(k=dims, inputCol="__c", outputCol="__p"),
    ]
    fitted = Pipeline(stages=stages).fit(rows).transform(rows)
    p = vector_to_array("__p")
    return fitted.select(*keys, *[p[i].alias(f"pc{i + 1}") for i in range(dims)])


def project_random(
    topics: DataFrame, keys: list[str], k: int, theta: str = "theta", dims: int = 2, seed: int = 42
) -> DataFrame:
    """Gaussian random projection with a seeded matrix."""
    matrix = np.random.default_rng(seed).normal(0.0, 1.0 / np.sqrt(dims), (dims, k))
    axes = [
        V.dot(F.col(theta), F.array(*[F.lit(float(x)) for x in row])).alias(f"rp{i + 1}")
        for i, row in enumerate(matrix)
    ]
    return topics.select(*keys, *axes)

