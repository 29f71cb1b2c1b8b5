"""Sampling, sharding and path expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def crc_shard(key, shards: int) -> Column:
    """Shard number from the CRC-32 of the key."""
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(shards)).cast("int")


def md5_shard(key, shards: int) -> Column:
    """Shard number from the first 28 bits of the MD5 of the key."""
    digits = F.substring(F.md5(F.col(key).cast("string")), 1, 7)
    return F.pmod(F.conv(digits, 16, 10).cast("bigint"), F.lit(shards)).cast("int")


def unit_hash(*keys: str, seed: int = 42) -> Column:
    """Number in [0, 1) that depends on the key and the seed only: 28 bits of an MD5."""
    named = F.concat_ws("\x1f", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(named), 1, 7), 16, 10).cast("bigint") / F.lit(float(1 << 28))


def path_part(index_from_end: int) -> Column:
    """Part of the input file path, counted from the end (1 is the file name)."""
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -index_from_end)


def month_in_path(pattern: str) -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)


def split_of(date: Column, last_train: str = "2023-02") -> Column:
    """Train or test by the last training month."""
    return F.when(date <= last_train, F.lit("train")).otherwise(F.lit("test"))
