"""Topic models, NMF, projections, embeddings: invariants."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.ml.linalg import VectorUDT, Vectors
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from strata.functions import vectors as V
from strata.operators import models, topics


@pytest.fixture(scope="module")
def bags(spark):
    rng = random.Random(0)
    rows = []
    for i in range(60):
        pool = ["chat", "chien", "souris"] if i % 2 else ["soleil", "lune", "ciel"]
        rows.append((f"d{i}", [rng.choice(pool) for _ in range(12)]))
    rows.append(("empty", ["inconnu"]))
    return spark.createDataFrame(rows, "docid string, tokens_phrased array<string>")


@pytest.fixture(scope="module")
def vocabulary(bags):
    return topics.fit_vocabulary(bags, size=100, min_df=2, max_df=0.9)


@pytest.fixture(scope="module")
def features(bags, vocabulary):
    return topics.vectorise(bags, vocabulary)


PARAMS = dict(max_iter=8, subsampling_rate=1.0, learning_offset=4.0)


def test_vocabulary_bounds(vocabulary):
    assert set(vocabulary.vocabulary) == {"chat", "chien", "souris", "soleil", "lune", "ciel"}


def test_lda_theta(spark, features, vocabulary):
    model = topics.fit_lda(features, ["docid"], 2, **PARAMS)
    rows = topics.infer(model, features, ["docid"]).collect()
    for r in rows:
        if r["docid"] == "empty":
            assert r["vocab_hits"] == 0 and r["highest_topic"] is None
        else:
            assert sum(r["theta"]) == pytest.approx(1.0) and min(r["theta"]) >= 0
            assert r["highest_topic"] == int(np.argmax(r["theta"]))
    words = topics.topic_words(model, topics.vocabulary_table(vocabulary, spark), 3).collect()
    tops = {t: {r["word"] for r in words if r["topic"] == t} for t in (0, 1)}
    assert sorted(map(sorted, tops.values())) == [["chat", "chien", "souris"], ["ciel", "lune", "soleil"]]
    wide = V.spread(topics.infer(model, features, ["docid"]), "theta", 2)
    assert wide.columns == ["docid", "vocab_hits", "highest_topic", "topic_0", "topic_1"]


def test_sweep_fits_missing_sizes_only(features):
    fitted = topics.fit_sweep(features, ["docid"], [2, 3, 4], done={3}, **PARAMS)
    assert sorted(fitted) == [2, 4] and fitted[4].getK() == 4
    assert topics.fit_sweep(features, ["docid"], [2], done={2}) == {}


def test_convergence_probe(spark):
    schema = StructType([StructField("docid", StringType()), StructField("features", VectorUDT())])
    rows = [(f"d{i}", Vectors.dense([float((i + j) % 5) for j in range(6)])) for i in range(60)]
    df = spark.createDataFrame(rows, schema)
    cells = topics.probe_convergence(df, ["docid"], 3, [2, 4], [16.0, 64.0], holdout=0.25, subsampling_rate=1.0)
    got = cells.collect()
    assert len(got) == 4 and len(cells.columns) == 9
    for r in got:
        assert math.isfinite(r["log_perplexity"]) and r["log_perplexity"] > 0
        assert r["train_n"] > 0 and r["holdout_n"] > 0 and r["train_n"] + r["holdout_n"] == 60


def test_nmf_reduces_the_error(spark, bags, vocabulary):
    stages = topics.fit_tfidf(bags, "tokens_phrased", size=100, min_df=2)
    rows = topics.sparse_rows(stages.transform(bags), ["docid"])
    errors = []
    for iterations in (1, 5, 25):
        h = topics.fit_nmf(rows, k=2, n_terms=6, iterations=iterations, steps=20)
        assert h.min() >= 0
        errors.append(topics.infer_nmf(rows, ["docid"], h).agg(F.sum("error")).first()[0])
    assert errors[0] > errors[1] > errors[2] - 1e-9
    scored = topics.infer_nmf(rows, ["docid"], h).collect()
    assert {r["highest_topic"] for r in scored if r["docid"] == "empty"} == {None}
    words = topics.matrix_words(h, stages.stages[0].vocabulary, spark, 3).collect()
    tops = [{r["word"] for r in words if r["topic"] == t} for t in (0, 1)]
    assert {"chat", "chien", "souris"} in tops


def test_sparse_rows_have_unit_length(spark, bags):
    stages = topics.fit_tfidf(bags, "tokens_phrased", size=100, min_df=2)
    rows = topics.sparse_rows(stages.transform(bags), ["docid"]).where("docid <> 'empty'")
    assert all(abs(sum(x * x for x in r["val"]) - 1) < 1e-9 for r in rows.collect())


def test_projections(spark):
    rng = random.Random(1)
    rows = [(str(i), [rng.random() * 10, rng.random(), 0.5]) for i in range(50)]
    df = spark.createDataFrame(rows, "docid string, theta array<double>")
    pcs = topics.project_pca(df, ["docid"]).orderBy(F.col("docid").cast("int")).collect()
    data = np.array([t for _, t in rows])
    centred = data - data.mean(axis=0)
    _, _, vt = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(np.abs([r["pc1"] for r in pcs]), np.abs(centred @ vt[0]), atol=1e-6)
    a = topics.project_random(df, ["docid"], 3).collect()
    assert a == topics.project_random(df, ["docid"], 3).collect() and len(a[0]) == 3


def test_baseline_pipeline(spark):
    docs = spark.createDataFrame([(str(i), "le chat noir " * 3 if i % 2 else "un grand soleil " * 3) for i in range(12)], "docid string, contents string")
    model = topics.baseline_pipeline(2, max_iter=2).fit(docs)
    assert "le" not in model.stages[2].vocabulary and model.transform(docs).count() == 12


def test_embedding_job(spark):
    long = "x " * 40
    docs = spark.createDataFrame([("a", long), ("a", long + "longer"), ("b", long), ("c", "short")], "docid string, contents string")
    out = models.embed_shards(docs, models.hashing_model(8), shards=4)
    got = out.collect()
    assert out.columns == ["docid", "contents", "embedding", "sample_id"]
    assert sorted(r["docid"] for r in got) == ["a", "b"]
    assert all(len(r["embedding"]) == 8 and all(isinstance(x, float) for x in r["embedding"]) for r in got)


def test_embedder_stage_and_prompt(spark):
    df = spark.createDataFrame([("hello world",), ("bonjour",)], "text string")
    stage = models.TextEmbedder(make_predict=models.hashing_model(4), inputCol="text", outputCol="transformed")
    out = stage.transform(df)
    assert out.columns == ["text", "transformed"] and all(len(r["transformed"]) == 4 for r in out.collect())
    prompted = df.select(models.prompted(F.col("text"), "nomic-ai/x").alias("p"), models.prompted(F.col("text"), "other").alias("q")).first()
    assert prompted["p"] == "search_document: hello world" and prompted["q"] == "hello world"


def test_vector_columns_become_arrays(spark):
    schema = StructType([StructField("v", VectorUDT())])
    df = V.as_array(spark.createDataFrame([(Vectors.sparse(3, [1], [2.0]),)], schema), "v")
    assert df.first()["v"] == [0.0, 2.0, 0.0]
    assert V.as_array(df, "v").schema == df.schema


def test_rerank_scores_every_pair(spark):
    pairs = spark.createDataFrame([("q", "d1", "red car", "a red car"), ("q", "d2", "red car", "a car")], "qid string, docid string, query string, contents string")
    got = {r["docid"]: r["score"] for r in models.rerank(pairs, models.overlap_scorer()).collect()}
    assert got == {"d1": 1.0, "d2": 0.5}


def test_sparse_rows_of_sparse_and_dense_vectors(spark):
    from pyspark.ml.linalg import Vectors

    data = [(1, Vectors.sparse(6, [1, 4], [3.0, 4.0])), (2, Vectors.dense([0.0, 0.0, 5.0, 0.0, 12.0, 0.0])), (3, Vectors.sparse(6, [], []))]
    got = {r["id"]: (r["idx"], r["val"]) for r in topics.sparse_rows(spark.createDataFrame(data, ["id", "features"]), ["id"]).collect()}
    assert got == {1: ([1, 4], [0.6, 0.8]), 2: ([2, 4], [5 / 13, 12 / 13]), 3: ([], [])}


def test_long_rows_are_scaled_in_linear_time(spark):
    """A length that is summed for every cell takes minutes for so many."""
    n = 40_000
    data = spark.createDataFrame([(1, Vectors.sparse(n, list(range(n)), [2.0] * n))], ["id", "features"]).localCheckpoint()
    start = time.monotonic()
    row = topics.sparse_rows(data, ["id"]).select(F.size("idx"), F.array_max("val")).first()
    assert row[0] == n and row[1] == pytest.approx(1 / math.sqrt(n))
    assert time.monotonic() - start < 20


def test_nmf_weights_equal_those_of_single_rows(spark):
    """More rows than are solved side by side, some without cells, against the update of one row."""
    rng = np.random.default_rng(3)
    h = rng.random((3, 9))
    data = []
    for i in range(topics.SOLVED + 50):
        at = sorted(rng.choice(9, int(rng.integers(0, 6)), replace=False).tolist())
        data.append((i, at, rng.random(len(at)).tolist()))
    rows = spark.createDataFrame(data, "id int, idx array<int>, val array<double>").coalesce(1)
    got = {r["id"]: r for r in topics.infer_nmf(rows, ["id"], h, steps=7).collect()}
    assert len(got) == len(data)
    for i, at, x in data:
        w = np.full(3, 1 / 3)
        for _ in range(7):
            w = w * (h[:, at] @ x) / (h @ h.T @ w + 1e-12)
        whole = np.zeros(9)
        whole[at] = x
        assert np.allclose(got[i]["theta"], w, rtol=1e-9) and got[i]["error"] == pytest.approx(float(((whole - w @ h) ** 2).sum()), abs=1e-9)
