"""Collocation mining: counts, NPMI scores, list screen, and application."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from strata.functions import text as X
from strata.operators.ranking import unnest
from strata.session import MAX_BROADCAST_ROWS, fits, lookup_join, written


def unigram_counts(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    return (
        unnest(docs, [], tokens, "w")
        .groupBy("w")
        .agg(F.count(F.lit(1)).alias("w_count"))
    )


def _flat(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """All tokens of a batch, and the number of the row that each is in."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten(), np.repeat(np.arange(len(lists)), lengths)


def _pair_counts(batches):
    """Rows (a, b, count) of each batch."""
    for batch in batches:
        flat, row = _flat(batch.column(0))
        coded = flat.dictionary_encode(null_encoding="encode")
        code, size = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(coded.dictionary))
        pairs = (code[:-1] * size + code[1:])[row[:-1] == row[1:]]
        found, n = np.unique(pairs, return_counts=True)
        words = coded.dictionary.cast(pa.string())
        yield pa.RecordBatch.from_arrays([words.take(pa.array(found // size)), words.take(pa.array(found % size)), pa.array(n)], ["a", "b", "n"])


def bigram_counts(docs: DataFrame, tokens: str = "tokens", min_count: int = 1) -> DataFrame:
    """Counts of neighbouring token pairs; counted batch by batch, then reduced in the map tasks before the shuffle."""
    pairs = docs.select(tokens).mapInArrow(_pair_counts, "a string, b string, n bigint")
    counts = pairs.groupBy("a", "b").agg(F.sum("n").alias("count"))
    return counts.where(F.col("count") >= min_count)


def npmi(bigrams: DataFrame, unigrams: DataFrame, min_count: int = 20, threshold: float = 0.5) -> DataFrame:
    """Normalised pointwise mutual information of word pairs.

    All three probabilities share one denominator, the count of all tokens
    before ``min_count`` is applied.
    """
    total = unigrams.agg(F.sum("w_count").cast("double").alias("t")).scalar()
    frequent = unigrams.where(F.col("w_count") >= min_count)
    pairs = bigrams.where(F.col("count") >= min_count)
    for side in ("a", "b"):
        dim = frequent.select(F.col("w").alias(side), F.col("w_count").alias(f"{side}_count"))
        pairs = lookup_join(pairs, dim, [side], f"{side}_count")
    with_total = pairs.withColumn("t", total)
    p_ab = F.col("count") / F.col("t")
    pmi = F.ln(p_ab / ((F.col("a_count") / F.col("t")) * (F.col("b_count") / F.col("t"))))
    scored = with_total.withColumn("npmi", F.try_divide(pmi, -F.ln(p_ab)))
    return scored.where(F.col("npmi") >= threshold).select("a", "b", "npmi", "count")


def screen_lists(scored: DataFrame, ceiling: float = 0.95, percentile: float = 99.9) -> DataFrame:
    """Drop near-perfect pairs that are also in the extreme tail of the counts.

    The cut is the exact discrete percentile of the counts of pairs with
    ``npmi >= ceiling``.  Without such pairs nothing is dropped, and a ceiling
    above 1 switches the screen off.
    """
    suspects = scored.where(F.col("npmi") >= ceiling).groupBy("count").agg(
        F.count(F.lit(1)).alias("n")
    )
    # The smallest count whose cumulative share reaches the percentile.
    total = suspects.agg(F.sum("n").alias("t")).scalar()
    running = F.sum("n").over(Window.orderBy("count"))  # one row per distinct count
    cut = (
        suspects.withColumn("c", running)
        .where(F.col("c") >= F.lit(percentile / 100.0) * total)
        .agg(F.min("count").alias("cut"))
    )
    limit = cut.scalar()
    listed = (F.col("npmi") >= ceiling) & (F.col("count") >= limit)
    return scored.where(~F.coalesce(listed, F.lit(False)))


def score_pairs(
    docs: DataFrame, tokens: str = "tokens", min_count: int = 20, threshold: float = 0.5
) -> DataFrame:
    """NPMI scores of a tokenized corpus.

    The counts are stored in the shared folder first: each is read several
    times, and the corpus only once per kind of count.
    """
    unigrams = written(unigram_counts(docs, tokens), "unigrams")
    bigrams = written(bigram_counts(docs, tokens, min_count), "bigrams")
    return npmi(bigrams, unigrams, min_count, threshold)


def mine(
    docs: DataFrame,
    tokens: str = "tokens",
    min_count: int = 20,
    threshold: float = 0.5,
    ceiling: float = 0.95,
    percentile: float = 99.9,
) -> DataFrame:
    """Phrase table ``a, b, npmi, count`` of a tokenized corpus."""
    scored = written(score_pairs(docs, tokens, min_count, threshold), "scored")
    return screen_lists(scored, ceiling, percentile)


def append_phrases(
    docs: DataFrame,
    phrases: DataFrame,
    keys: list[str],
    tokens: str = "tokens",
    into: str = "tokens_phrased",
    separator: str = "_",
    max_broadcast: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Append the phrases of a document to its tokens, which are all kept.

    A phrase table within the broadcast bound is looked up inside the rows.  With a
    larger one, occurrences are joined by shuffle with its hot phrases split off, and
    gathered again by ``keys``, which must identify a document (slice and docid).
    """
    if fits(phrases, max_broadcast):
        return _append_known(docs, phrases.select("a", "b").toArrow(), tokens, into, separator)
    found = docs.select(*keys, F.posexplode(X.adjacent_pairs(tokens)).alias("pos", "p")).select(
        *keys, "pos", "p.a", "p.b"
    )
    hits = lookup_join(found, phrases.select("a", "b", "count"), ["a", "b"], "count")
    token = F.concat_ws(separator, "a", "b").alias("t")
    kept = hits.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("pos", token))).alias("__kept")
    )
    joined = docs.join(kept, keys, "left")
    extra = F.coalesce(F.transform("__kept", lambda s: s["t"]), F.array().cast("array<string>"))
    return joined.withColumn(into, F.concat(F.col(tokens), extra)).drop("__kept")


def _append_known(docs: DataFrame, known: pa.Table, tokens: str, into: str, separator: str) -> DataFrame:
    """``docs`` with the phrases of ``known`` (a, b) that a row's neighbouring tokens make, in their order."""
    sides = [known.column(c).combine_chunks().cast(pa.string()) for c in ("a", "b")]
    words = pc.unique(pa.concat_arrays(sides)).drop_null()
    size = max(1, len(words))
    a, b = [pc.fill_null(pc.index_in(side, value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64) for side in sides]
    pairs = np.unique((a * size + b)[(a >= 0) & (b >= 0)])
    fields = [f for f in docs.schema.fields if f.name != into]
    told = StructType([*fields, StructField(into, ArrayType(StringType()))])
    schema = to_arrow_schema(told)

    def run(batches):
        for batch in batches:
            lists = batch.column(tokens)
            flat, row = _flat(lists)
            flat = flat.cast(pa.string())
            code = pc.fill_null(pc.index_in(flat, value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            near = (row[:-1] == row[1:]) & (code[:-1] >= 0) & (code[1:] >= 0)
            at = np.flatnonzero(near)
            at = at[np.isin(code[at] * size + code[at + 1], pairs)]
            extra = pc.binary_join_element_wise(flat.take(pa.array(at)), flat.take(pa.array(at + 1)), separator)
            # The sort is stable: a row's tokens come before its phrases.
            rows = np.concatenate([row, row[at]])
            values = pa.concat_arrays([flat, extra]).take(pa.array(np.argsort(rows, kind="stable")))
            ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(lists)))]).astype(np.int32)
            whole = pa.ListArray.from_arrays(pa.array(ends), values, type=schema.field(into).type, mask=pc.is_null(lists))
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in fields], whole], schema=schema)

    return docs.mapInArrow(run, told)
