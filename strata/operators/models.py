"""Batch embedding and pair scoring with injected models.

A model is a function that makes a predict function; it runs once per Python
worker, and the predict function receives numpy batches.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import predict_batch_udf
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, Param, Params, TypeConverters
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from strata.functions import keys as K
from strata.operators import clean

MakePredict = Callable[[], Callable]

# Fixed value: model families that expect a task prefix before the text.
PROMPTS = {"nomic-ai": "search_document: "}


def prompted(text: Column, model_name: str) -> Column:
    """Put the prompt of the model family before the text."""
    for family, prompt in PROMPTS.items():
        if model_name.startswith(family):
            return F.concat(F.lit(prompt), text)
    return text


def embed(
    df: DataFrame,
    make_predict: MakePredict,
    text: str = "contents",
    into: str = "embedding",
    model_name: str = "",
    batch_size: int = 64,
) -> DataFrame:
    """Add an ``array<float>`` embedding of a text column."""
    predict = predict_batch_udf(make_predict, return_type=ArrayType(FloatType()), batch_size=batch_size)
    return df.withColumn(into, predict(prompted(F.col(text), model_name)))


class TextEmbedder(Transformer, HasInputCol, HasOutputCol):
    """Pipeline-stage form of :func:`embed`."""

    modelName = Param(Params._dummy(), "modelName", "name of the model", TypeConverters.toString)
    batchSize = Param(Params._dummy(), "batchSize", "rows per predict call", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, make_predict, inputCol="contents", outputCol="embedding", modelName="", batchSize=64):
        super().__init__()
        self._make_predict = make_predict
        self._set(inputCol=inputCol, outputCol=outputCol, modelName=modelName, batchSize=batchSize)

    def _transform(self, df: DataFrame) -> DataFrame:
        return embed(
            df,
            self._make_predict,
            self.getInputCol(),
            self.getOutputCol(),
            self.getOrDefault(self.modelName),
            self.getOrDefault(self.batchSize),
        )


def embed_shards(docs: DataFrame, make_predict: MakePredict, shards: int, key: str = "docid", **options) -> DataFrame:
    """Deduplicated documents with embedding and shard number, all shards in one job."""
    kept = clean.keep_longest(docs, [key])
    return embed(kept, make_predict, **options).withColumn("sample_id", K.crc_shard(key, shards))


def rerank(pairs: DataFrame, make_predict: MakePredict, batch_size: int = 64) -> DataFrame:
    """Replace the score of every (query, contents) pair by the injected scorer's."""
    predict = predict_batch_udf(make_predict, return_type=DoubleType(), batch_size=batch_size)
    # Candidates of one query lie together after the joins; spread them evenly.
    spread = pairs.repartition(F.col("qid"), F.col("docid"))
    return spread.withColumn("score", F.round(predict("query", "contents"), 6))


# --- deterministic stand-ins for tests and the registered queries ---------------------


def hashing_model(dims: int = 32) -> MakePredict:
    """Embedding by hashed words, unit length."""

    def make():
        import zlib

        def predict(texts: np.ndarray) -> np.ndarray:
            out = np.zeros((len(texts), dims), dtype=np.float32)
            for row, text in enumerate(texts):
                for word in str(text).lower().split():
                    code = zlib.crc32(word.encode())
                    out[row, code % dims] += 1.0 if code & 0x10000 else -1.0
            size = np.linalg.norm(out, axis=1, keepdims=True)
            return out / np.where(size > 0, size, 1.0)

        return predict

    return make


def overlap_scorer() -> MakePredict:
    """Share of distinct query words that the document contains."""

    def make():
        def predict(queries: np.ndarray, texts: np.ndarray) -> np.ndarray:
            scores = []
            for query, text in zip(queries, texts):
                words = set(str(query).lower().split())
                have = set(str(text).lower().split())
                scores.append(len(words & have) / max(len(words), 1))
            return np.asarray(scores, dtype=np.float64)

        return predict

    return make
