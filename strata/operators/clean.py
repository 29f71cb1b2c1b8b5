"""Slice filters, samples, shards, deduplication and unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions import keys as K
from strata.functions import text as X
from strata.session import MAX_BROADCAST_ROWS

POOLED = "all"


# --- filters -----------------------------------------------------------------


def slice_filter(df: DataFrame, date: str) -> DataFrame:
    """Rows of one slice; the sentinel ``all`` keeps every slice."""
    return df if date == POOLED else df.where(F.col("date") == date)


def with_query(df: DataFrame) -> DataFrame:
    return df.where(F.col("query").isNotNull())


def longer_than(df: DataFrame, n: int = 50, column: str = "contents") -> DataFrame:
    return df.where(F.length(column) > n)


def oversize(df: DataFrame, words: int = 50, column: str = "query") -> DataFrame:
    """Rows whose text has more than ``words`` words."""
    counted = df.withColumn("words", X.words_by_blank(column))
    return counted.where(F.col("words") > words)


def rel_or_zero(df: DataFrame, column: str = "rel") -> DataFrame:
    """NULL grade of an unjudged row to 0; no other column is touched."""
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(0)))


# --- samples and shards --------------------------------------------------------


def hash_sample(df: DataFrame, keys: list[str], fraction: float, seed: int = 42) -> DataFrame:
    """Bernoulli sample decided by the key, so it does not depend on file layout."""
    return df.where(K.unit_hash(*keys, seed=seed) < fraction)


def bernoulli_sample(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Spark's own sampler; its draw depends on the partitioning."""
    return df.sample(fraction=fraction, seed=seed)


def holdout_split(
    df: DataFrame, keys: list[str], fraction: float, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """(train, holdout), disjoint and complete, decided by the key."""
    held = K.unit_hash(*keys, seed=seed) < fraction
    return df.where(~held), df.where(held)


def draw_queries(df: DataFrame, n: int, seed: int, key: str = "qid") -> DataFrame:
    """Rows of exactly ``n`` keys drawn by hash order (0 keeps all).

    The drawn keys are broadcast only if ``n`` is below ``MAX_BROADCAST_ROWS``."""
    if n <= 0:
        return df
    order = F.md5(F.concat_ws("\x1f", F.lit(str(seed)), F.col(key).cast("string")))
    drawn = df.select(key).distinct().orderBy(order, key).limit(n)
    return df.join(F.broadcast(drawn) if n <= MAX_BROADCAST_ROWS else drawn, key, "left_semi")


def shard(df: DataFrame, key: str, shards: int, only: int | None = None) -> DataFrame:
    """Add ``sample_id``; keep a single shard if ``only`` is given."""
    marked = df.withColumn("sample_id", K.crc_shard(key, shards))
    return marked if only is None else marked.where(F.col("sample_id") == only)


# --- deduplication ---------------------------------------------------------------
# All three rules are aggregates, not windows: copies are reduced inside the map
# tasks first, so a key with very many copies costs one row per map task.


def _one_per_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    payload = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*payload), order).alias("__best"))
    return best.select(*keys, *[F.col("__best")[c].alias(c) for c in payload]).select(*df.columns)


def keep_longest(
    df: DataFrame, keys: list[str], column: str = "contents", min_length: int = 50
) -> DataFrame:
    """One row per key: the longest text, ties by the smallest SHA-256."""
    order = F.struct((-F.length(column)).alias("l"), F.sha2(F.col(column), 256).alias("h"))
    return _one_per_key(longer_than(df, min_length, column), keys, order)


def keep_smallest_hash(df: DataFrame, keys: list[str], column: str = "contents") -> DataFrame:
    """One row per key: the text with the smallest SHA-256."""
    return _one_per_key(df, keys, F.sha2(F.col(column), 256))


def first_text(df: DataFrame, key: str = "qid", text: str = "query", order: str = "date") -> DataFrame:
    """Text of the earliest slice per key, ties by the text itself."""
    return df.groupBy(key).agg(F.min_by(text, F.struct(order, text)).alias(text))


# --- set operations ----------------------------------------------------------------


def union_all(frames: list[DataFrame], allow_missing: bool = False) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), frames)


def union_as(first: DataFrame, other: DataFrame) -> DataFrame:
    """Union after casting the second frame's columns to the types of the first."""
    cast = other.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in first.schema.fields])
    return first.unionByName(cast)


def set_sizes(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: sizes of the intersection, the differences and the union of two key sets."""
    sides = union_all(
        [
            left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")),
            right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")),
        ]
    )
    seen = sides.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return seen.agg(
        F.count(F.when((F.col("l") == 1) & (F.col("r") == 1), 1)).alias("both"),
        F.count(F.when(F.col("r") == 0, 1)).alias("left_only"),
        F.count(F.when(F.col("l") == 0, 1)).alias("right_only"),
        F.count(F.lit(1)).alias("either"),
    )


# --- nested records ------------------------------------------------------------------


def flatten(df: DataFrame, struct_column: str, drop: list[str] | None = None) -> DataFrame:
    """Fields of a struct column as columns of their own."""
    rest = [c for c in df.columns if c != struct_column]
    return df.select(*rest, f"{struct_column}.*").drop(*(drop or []))


def explode_records(df: DataFrame, array_column: str, drop: list[str] | None = None) -> DataFrame:
    """One row per array element (one NULL row for an empty array), fields flattened."""
    rest = [c for c in df.columns if c != array_column]
    rows = df.select(*rest, F.explode_outer(array_column).alias("__record"))
    return flatten(rows, "__record", drop)
