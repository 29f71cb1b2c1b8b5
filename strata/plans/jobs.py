"""Whole jobs over a stored collection: what the command line runs.

Each job reads parquet, composes operators, and writes parquet below its output
folder, so that jobs can be run one after another by any scheduler.
"""

from __future__ import annotations

import hashlib
import time

from pyspark.ml.clustering import LocalLDAModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import keys as K
from strata.functions import text as X
from strata.functions import vectors as V
from strata.operators import clean, coherence, drift, evaluate, models, phrases, retrieval, stats, topics
from strata.sources import readers, sinks
from strata.sources.collections import ParquetCollection

DOC = ["date", "docid"]


def _save(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def documents(spark: SparkSession, roots: list[str], date: str = clean.POOLED) -> DataFrame:
    """Documents of one or several collections (train and test), one slice or all."""
    return clean.slice_filter(clean.union_all([ParquetCollection(spark, r).documents for r in roots], True), date)


# --- corpus -----------------------------------------------------------------------


def token_statistics(spark: SparkSession, roots: list[str], out: str, analyzer: X.Analyzer = X.simple_tokens) -> None:
    """Token and word counts per document, and their summaries."""
    _save(stats.counted(documents(spark, roots), analyzer), f"{out}/counts")
    counts = spark.read.parquet(f"{out}/counts")
    sinks.write_summary(stats.length_summary(counts, ["split", "language"]), f"{out}/summary")
    sinks.write_summary(stats.length_sets(counts), f"{out}/summary_sets")


def diagnostics(spark: SparkSession, roots: list[str], out: str) -> None:
    """Lengths, uniqueness and English density per slice and over all slices: texts are read once."""
    _save(stats.thin_rows(documents(spark, roots), ["date"]), f"{out}/thin")
    thin = spark.read.schema("date string, chars bigint, text_hash string, density double").parquet(f"{out}/thin")
    sinks.write_summary(stats.diagnostics(thin, ["date"]), f"{out}/by_date")
    pooled = thin.withColumn("date", F.lit(clean.POOLED))
    sinks.write_summary(stats.diagnostics(pooled, ["date"]), f"{out}/pooled")


def embeddings(
    spark: SparkSession, roots: list[str], out: str, make_predict: models.MakePredict, shards: int = 8, **options
) -> None:
    rows = models.embed_shards(documents(spark, roots), make_predict, shards, **options)
    _save(V.as_array(rows, "embedding"), f"{out}/data", ["sample_id"])


# --- topics -------------------------------------------------------------------------


def tokenized(docs: DataFrame, analyzer: X.Analyzer, stop_words: list[str] | None = None) -> DataFrame:
    stop = stop_words or X.analyzed_stop_forms(docs.sparkSession, analyzer)
    return docs.select(*DOC, X.content_tokens(analyzer(F.col("contents")), stop).alias("tokens"))


def preprocess(
    spark: SparkSession,
    roots: list[str],
    out: str,
    date: str = clean.POOLED,
    sample: float = 1.0,
    analyzer: X.Analyzer = X.french_tokens,
    min_count: int = 20,
    threshold: float = 0.5,
    ceiling: float = 0.95,
    percentile: float = 99.9,
    vocabulary_size: int = 20_000,
    min_df: float = 50,
    max_df: float = 0.2,
) -> None:
    """Tokens, phrases, phrased tokens, vocabulary and term vectors."""
    docs = documents(spark, roots, date)
    if sample < 1.0:
        docs = clean.hash_sample(docs, DOC, sample)
    _save(tokenized(docs, analyzer), f"{out}/tokens")
    tokens = spark.read.parquet(f"{out}/tokens")
    found = phrases.mine(tokens, "tokens", min_count, threshold, ceiling, percentile)
    _save(found.orderBy(F.desc("npmi"), "a", "b"), f"{out}/phrases")
    apply_features(spark, tokens, out, out, fit=(vocabulary_size, min_df, max_df))


def apply_features(spark: SparkSession, tokens: DataFrame, trained: str, out: str, fit=None) -> None:
    """Phrase and vectorise tokens with the phrases and vocabulary of ``trained``."""
    phrased = phrases.append_phrases(tokens, spark.read.parquet(f"{trained}/phrases"), DOC)
    _save(phrased.select(*DOC, "tokens_phrased"), f"{out}/tokens_phrased")
    rows = spark.read.parquet(f"{out}/tokens_phrased")
    if fit:
        size, min_df, max_df = fit
        vocabulary = topics.fit_vocabulary(rows, size=size, min_df=min_df, max_df=max_df)
        sinks.save_model(vocabulary, f"{trained}/vocabulary")
    vocabulary = CountVectorizerModel.load(f"{trained}/vocabulary")
    _save(topics.vectorise(rows, vocabulary).select(*DOC, "features", "vocab_hits"), f"{out}/features")


def settings_of(params: dict) -> str:
    """Name of a set of training parameters, part of the marker of a fitted size."""
    return hashlib.sha256(repr(sorted(params.items())).encode()).hexdigest()[:16]


def fitted_sizes(spark: SparkSession, out: str, ks: list[int], params: dict) -> set[int]:
    """Sizes whose model was saved whole with these parameters."""
    return {k for k in ks if readers.exists(spark, f"{out}/k{k}/fitted-{settings_of(params)}/_SUCCESS")}


def _save_size(spark: SparkSession, model, k: int, out: str, params: dict) -> None:
    """Save a model, drop what an earlier one left, and set the marker last."""
    for left in ("fitted-*", "doc_topics"):
        readers.remove(spark, f"{out}/k{k}/{left}")
    sinks.save_model(model, f"{out}/k{k}/model")
    _save(spark.createDataFrame([(repr(sorted(params.items())),)], "params string"), f"{out}/k{k}/fitted-{settings_of(params)}")


def lda_sweep(spark: SparkSession, prepared: str, out: str, ks: list[int], top_n: int = 10, **params) -> None:
    """Fit the sizes that are missing, infer, and score every size.

    Every model is saved as soon as it is fitted, and every later step looks for
    its own result, so a run that was stopped anywhere goes on where it was.
    """
    features = spark.read.parquet(f"{prepared}/features")
    done = fitted_sizes(spark, out, ks, params)
    for k, model in topics.fit_each(features, DOC, ks, done, **params):
        _save_size(spark, model, k, out, params)
    words = topics.vocabulary_table(CountVectorizerModel.load(f"{prepared}/vocabulary"), spark)
    tables = []
    for k in ks:
        model = LocalLDAModel.load(f"{out}/k{k}/model")
        _save(topics.topic_words(model, words), f"{out}/k{k}/topic_words")
        if not readers.exists(spark, f"{out}/k{k}/doc_topics/_SUCCESS"):
            theta(spark, model, features, k, f"{out}/k{k}")
        tables.append(spark.read.parquet(f"{out}/k{k}/topic_words").withColumn("k", F.lit(k)))
    rows = spark.read.parquet(f"{prepared}/tokens_phrased")
    scored = coherence.coherence_table(rows, clean.union_all(tables), n=top_n)
    _save(scored.orderBy("k"), f"{out}/sweep")
    topic_proportions(spark, [f"{out}/k{k}" for k in ks], ks, out)


def theta(spark: SparkSession, model: LocalLDAModel, features: DataFrame, k: int, out: str) -> None:
    wide = V.spread(topics.infer(model, features, DOC), "theta", k)
    _save(wide, f"{out}/doc_topics")


def _proportions(spark: SparkSession, path: str, k: int) -> DataFrame:
    return drift.slice_proportions(V.gather(spark.read.parquet(f"{path}/doc_topics"), k), k)


def topic_proportions(spark: SparkSession, paths: list[str], ks: list[int], out: str) -> None:
    """Proportions per slice of every size, and drift over the slices."""
    long = clean.union_all([_proportions(spark, p, k) for p, k in zip(paths, ks)])
    _save(long.orderBy("k", "date", "topic"), f"{out}/proportions")
    _save(drift.drift(spark.read.parquet(f"{out}/proportions")).orderBy("k", "topic"), f"{out}/drift")


def heldout_drift(
    spark: SparkSession,
    prepared: str,
    trained: str,
    roots: list[str],
    out: str,
    ks: list[int],
    analyzer: X.Analyzer = X.french_tokens,
) -> None:
    """Score new slices with the train phrases, vocabulary and models; drift over all slices."""
    _save(tokenized(documents(spark, roots), analyzer), f"{out}/tokens")
    apply_features(spark, spark.read.parquet(f"{out}/tokens"), prepared, out)
    features = spark.read.parquet(f"{out}/features")
    for k in ks:
        if not readers.exists(spark, f"{out}/k{k}/doc_topics/_SUCCESS"):
            theta(spark, LocalLDAModel.load(f"{trained}/k{k}/model"), features, k, f"{out}/k{k}")
    held = clean.union_all([_proportions(spark, f"{out}/k{k}", k) for k in ks])
    seen = spark.read.parquet(f"{trained}/proportions").where(F.col("k").isin(ks))
    _save(drift.extend(seen, held).orderBy("k", "date", "topic"), f"{out}/proportions")
    _save(drift.drift(spark.read.parquet(f"{out}/proportions")).orderBy("k", "topic"), f"{out}/drift")


def convergence(spark: SparkSession, prepared: str, out: str, k: int, iterations, offsets, **params) -> None:
    features = spark.read.parquet(f"{prepared}/features")
    sinks.write_summary(topics.probe_convergence(features, DOC, k, iterations, offsets, **params), out)


def query_topics(
    spark: SparkSession, prepared: str, trained: str, queries: DataFrame, k: int, out: str, analyzer=X.french_tokens
) -> None:
    """Topics of queries in the frozen feature space of the documents."""
    once = clean.first_text(clean.with_query(queries))
    stop = X.analyzed_stop_forms(spark, analyzer)
    tokens = once.select("qid", "query", X.content_tokens(analyzer(F.col("query")), stop).alias("tokens"))
    phrased = phrases.append_phrases(tokens, spark.read.parquet(f"{prepared}/phrases"), ["qid"])
    known = topics.vectorise(phrased, CountVectorizerModel.load(f"{prepared}/vocabulary"))
    model = LocalLDAModel.load(f"{trained}/k{k}/model")
    _save(topics.infer(model, known, ["qid", "query"]), f"{out}/query_topics_k{k}")


def nmf(
    spark: SparkSession, roots: list[str], out: str, k: int, date: str = clean.POOLED, sample: float = 1.0, size: int = 20_000, iterations: int = 20
) -> None:
    """TF-IDF and NMF: fitted on one sample, applied to another."""
    docs = documents(spark, roots, date).select(*DOC, X.simple_tokens("contents").alias("tokens"))
    train = docs if sample >= 1.0 else clean.hash_sample(docs, DOC, sample, 42)
    other = docs if sample >= 1.0 else clean.hash_sample(docs, DOC, sample, 94)
    stages = topics.fit_tfidf(train, "tokens", size)
    words = stages.stages[0].vocabulary
    h = topics.fit_nmf(topics.sparse_rows(stages.transform(train), DOC), k, len(words), iterations)
    _save(topics.matrix_words(h, words, spark), f"{out}/topic_words")
    rows = topics.sparse_rows(stages.transform(other), DOC)
    _save(V.spread(topics.infer_nmf(rows, DOC, h), "theta", k), f"{out}/doc_topics")


# --- retrieval ---------------------------------------------------------------------------


def bm25(
    spark: SparkSession,
    roots: list[str],
    out: str,
    k: int = 100,
    shards: int = 8,
    expansions: str | None = None,
    analyzer: X.Analyzer = X.french_tokens,
    tag: str = "strata_bm25",
) -> None:
    """Index every slice, retrieve for every query, write runs, submissions and scores."""
    collections = [ParquetCollection(spark, r) for r in roots]
    docs = clean.keep_longest(documents(spark, roots).select(*DOC, "contents"), DOC)
    index = retrieval.write_index(docs, f"{out}/index", analyzer)
    queries = clean.with_query(clean.union_all([c.queries for c in collections], True)).select("date", "qid", "query")
    arms = {"original": queries}
    if expansions:
        arms["expanded"] = retrieval.expanded_or_original(queries, readers.expansions(spark, expansions))
    run = retrieval.search_shards(index, arms, shards, k, analyzer=analyzer)
    _save(run, f"{out}/retrieval", ["arm", "date"])
    stored = spark.read.parquet(f"{out}/retrieval")
    for arm in arms:
        rows = retrieval.submission(stored.where(F.col("arm") == arm), ["date", "qid"], tag)
        sinks.write_run(rows, f"{out}/submission/{arm}", require_rows=True)
    judged = [c.qrels for c in collections if c.qrels is not None]
    if judged:
        evaluation(spark, stored.withColumnRenamed("arm", "experiment"), clean.union_all(judged, True), out)


def rerank(
    spark: SparkSession,
    roots: list[str],
    run_path: str,
    out: str,
    make_predict: models.MakePredict,
    seeds: tuple[int, ...] = (42,),
    n_queries: int = 0,
    batch_size: int = 64,
) -> None:
    """Score the candidates of drawn queries with an injected model; runs, scores, throughput, seeds.

    ``n_queries`` of 0 takes every query.  A seed whose run is stored is not scored again.
    """
    collections = [ParquetCollection(spark, r) for r in roots]
    docs = clean.keep_longest(documents(spark, roots).select(*DOC, "contents"), DOC)
    queries = clean.with_query(clean.union_all([c.queries for c in collections], True)).select("date", "qid", "query")
    judged = clean.union_all([c.qrels for c in collections if c.qrels is not None], True)
    judged = judged.select(F.col("date").cast("string").alias("date"), "qid", "docid", "rel")
    run = spark.read.parquet(run_path).withColumn("date", F.col("date").cast("string"))
    tables = []
    for seed in seeds:
        path = f"{out}/seed{seed}"
        drawn = clean.draw_queries(run.select(*DOC, "qid", "score"), n_queries, seed)
        if not readers.exists(spark, f"{path}/seconds/_SUCCESS"):
            began = time.monotonic()
            _save(models.rerank(retrieval.candidates(drawn, docs, queries), make_predict, batch_size).drop("contents", "query"), f"{path}/run")
            _save(spark.createDataFrame([(time.monotonic() - began,)], "seconds double"), f"{path}/seconds")
        seconds = spark.read.parquet(f"{path}/seconds").first()["seconds"]
        for arm, rows, took in (("bm25", drawn, None), ("rerank", spark.read.parquet(f"{path}/run"), seconds)):
            scores = evaluate.evaluate(rows, judged, ["date", "qid"], ["date", "qid", "docid"])
            table = evaluate.run_summary(scores, rows, ["date"], took)
            tables.append(table.withColumn("arm", F.lit(arm)).withColumn("seed", F.lit(seed)))
    _save(clean.union_all(tables, True).withColumn("split", K.split_of(F.col("date"))), f"{out}/results")
    results = spark.read.parquet(f"{out}/results")
    sinks.write_summary(results, f"{out}/summary")
    sinks.write_summary(stats.seed_cells(results), f"{out}/by_seed")
    sinks.write_summary(stats.throughput(results), f"{out}/throughput")


def evaluation(spark: SparkSession, run: DataFrame, qrels: DataFrame, out: str) -> None:
    """Scores of every (experiment, date, query) and their means, in one job."""
    run = run.withColumn("date", F.col("date").cast("string"))
    qrels = qrels.select(F.col("date").cast("string").alias("date"), "qid", "docid", "rel")
    scores = evaluate.evaluate(run, qrels, ["experiment", "date", "qid"], ["date", "qid", "docid"])
    _save(scores, f"{out}/scores", ["experiment", "date"])
    sinks.write_summary(evaluate.summary(scores, ["experiment", "date"]), f"{out}/summary_by_date")
    sinks.write_summary(evaluate.summary(scores, ["experiment"]), f"{out}/summary")
