"""Row expansion, top-k and positions that do not put a whole group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unnest(df: DataFrame, keep: list, array, into: str) -> DataFrame:
    """One row per element of a computed array column.

    A plain ``explode`` of a column lets the optimizer infer ``size(column) > 0``
    and push it below the projection, which evaluates the array, here usually a
    tokenizer, a second time.  The outer form infers nothing.
    """
    rows = df.select(*keep, F.explode_outer(array).alias(into))
    return rows.where(F.col(into).isNotNull())


def top_k(
    df: DataFrame, group: list[str], order: list[Column], k: int, into: str = "rank", base: int = 0
) -> DataFrame:
    """First ``k`` rows per group.  Spark limits every map-side group to ``k`` rows
    before the shuffle, so a large group is cut down where it is stored.

    The hash of the group comes first in the sort: rows of different groups are
    told apart by one number instead of by their key columns."""
    w = Window.partitionBy(F.xxhash64(*group), *group).orderBy(*order)
    ranked = df.withColumn(into, F.row_number().over(w)).where(F.col(into) <= k)
    return ranked.withColumn(into, F.col(into) - 1 + base) if base != 1 else ranked


def positions(
    df: DataFrame, group: list[str], bucket: Column, order: list[Column], into: str = "pos"
) -> DataFrame:
    """1-based position of every row of its group.

    ``bucket`` must be non-decreasing in the sort order.  Rows are numbered
    inside (group, bucket), and the bucket's offset is added; the offsets come
    from counts that are reduced before the shuffle.
    """
    marked = df.withColumn("__bucket", bucket)
    sizes = marked.groupBy(*group, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sizes.select(
        *group, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")
    )
    local = Window.partitionBy(*group, "__bucket").orderBy(*order)
    numbered = marked.withColumn("__local", F.row_number().over(local))
    joined = numbered.join(offsets, [*group, "__bucket"])
    return joined.withColumn(into, F.col("__before") + F.col("__local")).drop(
        "__bucket", "__local", "__before"
    )


def running_sums(
    df: DataFrame, group: list[str], at: str, sums: dict[str, Column], width: int = 1024
) -> DataFrame:
    """Sums over all rows of the group up to and including position ``at``.

    Positions are distinct integers.  Sums run inside blocks of ``width``
    positions and the total of the blocks before is added, so a group of any
    size is worked on by many tasks.
    """
    parts = {f"__v{i}": c for i, c in enumerate(sums.values())}
    rows = df.select("*", F.floor(F.col(at) / width).alias("__block"), *[c.alias(n) for n, c in parts.items()])
    blocks = rows.groupBy(*group, "__block").agg(*[F.sum(n).alias(n) for n in parts])
    before = Window.partitionBy(*group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        *group, "__block", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}b") for n in parts]
    )
    inside = Window.partitionBy(*group, "__block").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select("*", *[F.sum(n).over(inside).alias(f"{n}l") for n in parts])
    joined = local.join(offsets, [*group, "__block"])
    return joined.select(
        *df.columns, *[(F.col(f"{n}b") + F.col(f"{n}l")).alias(into) for into, n in zip(sums, parts)]
    )
