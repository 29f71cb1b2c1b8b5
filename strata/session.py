"""Session-level helpers: shared scratch space and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows above which a join side is never broadcast by this package.
MAX_BROADCAST_ROWS = 1_000_000

# The same for rows of a topic vector each (about 1 kB).
MAX_BROADCAST_VECTORS = 20_000

# Rows of a broadcast table of key bits: 16 bytes each.
FILTER_CELLS = 1 << 16

# Share of a weighted key set above which a key counts as hot.  At most
# HOT_PARTS keys can each hold 1/HOT_PARTS of the total weight, so a table of
# hot keys has a proven size bound.
HOT_PARTS = 1000


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a session of one machine may name none; it gets a temporary folder.  On
    a cluster every executor would write parts to a disk of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    require_one_machine(spark.sparkContext.master)
    fallback = tempfile.mkdtemp(prefix="strata-")
    spark.conf.set("spark.checkpoint.dir", fallback)
    spark.sparkContext.setCheckpointDir(fallback)
    return fallback


def require_one_machine(master: str) -> None:
    """Refuse a cluster that names no shared folder."""
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/strata/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    Used where several consumers would otherwise recompute an expensive input.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows.

    A plain count: one number per task is shuffled, whatever the size."""
    return df.count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint after a check of the size, else the frame unchanged."""
    return F.broadcast(df) if fits(df, max_rows) else df


def likely_in(df: DataFrame, on: list[str], keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose columns ``on`` occur in ``keys``, and a few others.

    ``keys`` becomes a table of bits with at most FILTER_CELLS rows, however many
    keys there are, so it can be broadcast: rows that match nothing are dropped
    before a shuffle.  No row whose key occurs is lost; with many keys the
    filter lets more rows through.
    """
    cell = F.expr(f"pmod(__h, {FILTER_CELLS}L)")
    bit = F.expr("shiftleft(1L, cast(pmod(shiftright(__h, 32), 64L) as int))")
    hashed = keys.select(F.xxhash64(*on).alias("__h"))
    bits = hashed.groupBy(cell.alias("__cell")).agg(F.bit_or(bit).alias("__bits"))
    marked = df.withColumn("__h", F.xxhash64(*on)).withColumn("__cell", cell)
    kept = marked.join(F.broadcast(bits), "__cell").where(F.col("__bits").bitwiseAND(bit) != 0)
    return kept.select(*df.columns)


def lookup_join(
    facts: DataFrame,
    dim: DataFrame,
    key: list[str],
    weight: str,
    how: str = "inner",
) -> DataFrame:
    """Join ``facts`` with a unique-keyed ``dim`` without a hot shuffle key.

    ``weight`` is a column of ``dim`` that grows with the number of fact rows
    of a key.  Keys with at least 1/HOT_PARTS of the total weight are joined by
    broadcast (there are at most HOT_PARTS of them); the remaining keys are
    joined by shuffle, and fact rows already served are spread over partitions
    by a key that matches nothing.
    """
    payload = [c for c in dim.columns if c not in key]
    total = dim.agg(F.sum(weight).alias("total")).scalar()
    hot = dim.where(F.col(weight) * F.lit(HOT_PARTS) >= total).select(
        *key, F.struct(*payload).alias("__hot")
    )
    marked = facts.join(F.broadcast(hot), key, "left")
    cold = dim.where(F.col(weight) * F.lit(HOT_PARTS) < total).select(
        *[F.col(k).alias(f"__k_{k}") for k in key],
        F.lit(-1).alias("__spread"),
        F.struct(*payload).alias("__cold"),
    )
    served = F.col("__hot").isNotNull()
    spread = F.when(served, F.pmod(F.xxhash64(*facts.columns), F.lit(4096)).cast("int")).otherwise(-1)
    marked = marked.withColumn("__fspread", spread)
    joined = marked.join(
        cold,
        [marked[k] == cold[f"__k_{k}"] for k in key] + [marked["__fspread"] == cold["__spread"]],
        "left",
    )
    found = F.coalesce("__hot", "__cold")
    if how == "inner":
        joined = joined.where(found.isNotNull())
    return joined.select(
        *[F.col(c) for c in facts.columns], *[found[c].alias(c) for c in payload]
    )


def spread_join(
    facts: DataFrame,
    dim: DataFrame,
    key: list[str],
    how: str = "inner",
    salts: int = 64,
    counted: DataFrame | None = None,
    broadcast_rows: int = 0,
) -> DataFrame:
    """Join where a key may hold a large share of ``facts``; ``dim`` has one row per key.

    Keys with at least 1/HOT_PARTS of the fact rows (at most HOT_PARTS keys,
    so their list can be broadcast) are split over ``salts`` partitions: fact
    rows by their content, and their ``dim`` row is repeated.  All other keys
    are joined as usual.  ``counted`` names a cheaper frame with the same keys
    to count hot keys in; the result does not depend on it.  A ``dim`` counted
    to have at most ``broadcast_rows`` rows is broadcast instead.
    """
    if broadcast_rows and fits(dim, broadcast_rows):
        return facts.join(F.broadcast(dim), key, how)
    counts = (facts if counted is None else counted).groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n").alias("t")).scalar()
    hot = F.broadcast(
        counts.where(F.col("__n") * F.lit(HOT_PARTS) >= total)
        .where(F.col("__n") > salts)
        .select(*key, F.lit(True).alias("__hot"))
    )
    salt = F.pmod(F.xxhash64(*facts.columns), F.lit(salts)).cast("int")
    left = facts.join(hot, key, "left").withColumn(
        "__salt", F.when(F.col("__hot"), salt).otherwise(0)
    )
    repeats = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = dim.join(hot, key, "left").withColumn("__salt", F.explode(repeats)).drop("__hot")
    return left.drop("__hot").join(right, [*key, "__salt"], how).drop("__salt")
