"""Contiguous shards of near equal bytes from global prefix sums.

Rows are range-partitioned by their order and stored with the number of their
partition.  Every partition's rows and bytes are summed; running sums over
these totals, one row per partition, give each partition's offset in the whole
table, and running sums inside a partition give each row's.  A row's shard is
the equal target into which its middle byte falls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import text_of
from strata.session import written

OVERHEAD = 8


def shards(docs: DataFrame, n_shards: int = 24, partitions: int | None = None) -> DataFrame:
    """Give every row of ``docs`` (doc_id, text) a shard and a slot, in order of doc_id.

    Returns doc_id, size (UTF-8 bytes plus ``OVERHEAD``; a null text has none),
    text_crc32, law, shard, slot, grown_shard.  Shards are contiguous in doc_id
    (nulls first); rows that repeat a doc_id are ordered by checksum and size.
    Slots count from 0 without gaps inside a shard.  The law is ``bytes``, so
    grown_shard is null.  A shard may stay empty if one text is larger than the
    target.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = text_of()
    narrow = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    order = ["doc_id", "text_crc32", "size"]
    ranged = narrow.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id())
    # Stored, so that the number of a row's partition is decided once.
    ranged = written(ranged, "shard-rows")
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    # One row per partition: n is a parameter, so this table is bounded and can be broadcast.
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(whole).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("upto", F.sum("size").over(inside)).withColumn("at", F.row_number().over(inside))
    middle = F.lit(2) * (F.col("bytes_before") + F.col("upto")) - F.col("size")
    placed = local.join(F.broadcast(offsets), "part").select(
        *order,
        F.floor(middle.cast("decimal(38,0)") * n_shards / (F.lit(2) * F.col("total"))).cast("int").alias("shard"),
        (F.col("rows_before") + F.col("at") - 1).alias("place"),
    )
    placed = written(placed, "shard-places")
    # At most n_shards rows.
    first = F.broadcast(placed.groupBy("shard").agg(F.min("place").alias("first")))
    return placed.join(first, "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("place") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def shards_sql(table: str = "documents", n_shards: int = 24) -> str:
    """The rows of the query in DuckDB SQL; the checksum is computed bit by bit."""
    step = "CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END"
    return f"""
WITH told AS (SELECT doc_id, coalesce(text, '') AS text FROM {table}),
codes AS (SELECT doc_id, octet_length(encode(text)) AS n, flatten(list_transform(string_split(text, ''), lambda s: CASE
    WHEN unicode(s) < 0 THEN []
    WHEN unicode(s) < 128 THEN [unicode(s)]
    WHEN unicode(s) < 2048 THEN [192 + (unicode(s) >> 6), 128 + (unicode(s) & 63)]
    WHEN unicode(s) < 65536 THEN [224 + (unicode(s) >> 12), 128 + ((unicode(s) >> 6) & 63), 128 + (unicode(s) & 63)]
    ELSE [240 + (unicode(s) >> 18), 128 + ((unicode(s) >> 12) & 63), 128 + ((unicode(s) >> 6) & 63), 128 + (unicode(s) & 63)] END)) AS b FROM told),
sized AS (SELECT doc_id, n + {OVERHEAD} AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(b, lambda x: x::BIGINT)),
    lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, w: {step})), 4294967295::BIGINT) AS text_crc32 FROM codes),
placed AS (SELECT *, sum(size) OVER w AS upto, row_number() OVER w - 1 AS place, sum(size) OVER () AS total FROM sized
    WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)),
cut AS (SELECT *, (((2 * upto - size) * {n_shards}) // (2 * total))::INTEGER AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, place - min(place) OVER (PARTITION BY shard) AS slot, NULL::INTEGER AS grown_shard FROM cut"""
