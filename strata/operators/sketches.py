"""Mergeable sketches of slices, stored once and merged for any set of slices.

A stored row per slice holds a quantile sketch (KLL) of text lengths, a distinct
count sketch (HLL) and a set sketch (theta) of keys.  Questions about any union
of slices, quantiles, distinct counts, overlaps of two slices, are answered from
these rows alone: the corpus is not read again, and a new slice adds a row.

With up to about 2^12 keys and 200 lengths in the slices asked for, answers are
exact; beyond that their standard error is about 1.6 % for counts and 1.3 % of
rank for quantiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KLL_K = 200
LOG_KEYS = 12


def slice_sketches(df: DataFrame, by: list[str], key: Column, length: Column) -> DataFrame:
    """One row per slice: ``by``, n, lengths (KLL), distinct (HLL), keys (theta).

    Null keys and lengths are left out of the sketches, not of ``n``.  Sketches are
    built in the map tasks; one bounded buffer per task and slice is shuffled.
    """
    rows = df.select(*by, key.alias("__key"), length.cast("bigint").alias("__length"))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.kll_sketch_agg_bigint("__length", F.lit(KLL_K)).alias("lengths"),
        F.hll_sketch_agg("__key", LOG_KEYS).alias("distinct"),
        F.theta_sketch_agg("__key", LOG_KEYS).alias("keys"),
    )


def add_slices(df: DataFrame, path: str, by: list[str], key: Column, length: Column) -> None:
    """Append the sketches of the slices in ``df`` to the store at ``path``.

    A slice may arrive in several parts; their sketches are merged when read.
    """
    slice_sketches(df, by, key, length).write.mode("append").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merged(store: DataFrame, by: list[str]) -> DataFrame:
    """One row per value of ``by`` (none: one row) from the stored rows of its slices."""
    return store.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.kll_merge_agg_bigint("lengths").alias("lengths"),
        F.hll_union_agg("distinct").alias("distinct"),
        F.theta_union_agg("keys").alias("keys"),
    )


def quantiles(sketches: DataFrame, by: list[str], at: list[float]) -> DataFrame:
    """Quantiles of the lengths and the number of distinct keys: ``by``, n, n_distinct, p<percent>."""
    columns = [
        F.kll_sketch_get_quantile_bigint("lengths", F.lit(q)).alias(f"p{round(100 * q):02d}") for q in at
    ]
    return sketches.select(*by, "n", F.hll_sketch_estimate("distinct").alias("n_distinct"), *columns)


def overlaps(sketches: DataFrame, slice_column: str) -> DataFrame:
    """Keys that neighbouring slices share: slice, next, n_both, n_either, jaccard.

    The store has one row per slice, so the window over slices is small.
    """
    from pyspark.sql import Window

    order = Window.orderBy(slice_column)
    paired = sketches.select(
        slice_column,
        "keys",
        F.lead(slice_column).over(order).alias("next"),
        F.lead("keys").over(order).alias("next_keys"),
    ).where(F.col("next").isNotNull())
    both = F.theta_sketch_estimate(F.theta_intersection("keys", "next_keys"))
    either = F.theta_sketch_estimate(F.theta_union("keys", "next_keys"))
    counted = paired.select(slice_column, "next", both.alias("n_both"), either.alias("n_either"))
    return counted.withColumn("jaccard", F.round(F.try_divide(F.col("n_both"), F.col("n_either")), 6))
