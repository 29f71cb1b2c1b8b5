"""Exact deduplication over an extendible-hash index.

The index lists every document by a 64-bit key of its text without white
space.  Its directory starts with one bucket and doubles while a bucket holds
more keys than fit: a full bucket is split by the next bit of the key, the
others keep several directory pointers.  Copies share a key and are counted
before anything is moved, so a bucket holds a key once, however many copies
there are.  Texts whose key occurs more than once are then read again and
compared byte by byte; texts that differ under one key are chained below it as
groups of their own.  Spark deals these chains by the hash of bucket, key and
text; the directory does not place rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import likely_in, text_of, without_white
from strata.session import lookup_join, written

# Bits of the key that the directory can use: at most 2^16 pointers.
DIRECTORY_BITS = 16
BUCKET_KEYS = 4096


def _step() -> Column:
    return F.lit(str(1 << 66)).cast("decimal(20,0)")


def _top() -> Column:
    return F.lit(str(1 << 63)).cast("decimal(20,0)")


def _rank() -> Column:
    """Orders rows by code points, then by smaller doc_id (null last).

    The number of code points times 2^66, plus a place below that for doc_id.
    """
    place = F.coalesce(_top() - F.col("doc_id").cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    return (F.col("n_chars").cast("decimal(10,0)") * _step() + place).cast("decimal(38,0)")


def _id_of(rank: Column) -> Column:
    place = rank % _step()
    return F.when(place > 0, (_top() - place).cast("long"))


def _key(body: Column) -> Column:
    return F.xxhash64(body)


def _cell(key: Column) -> Column:
    return F.shiftrightunsigned(key, 64 - DIRECTORY_BITS).cast("int")


def directory(cells: DataFrame, capacity: int = BUCKET_KEYS) -> DataFrame:
    """Directory pointers (``cell``, ``bucket``, ``depth``) for key counts per cell.

    ``cells`` has ``cell`` (the key's first ``DIRECTORY_BITS`` bits) and ``keys``.
    The directory doubles up to its last bit; a bucket that is still too full
    there stays so and is worked on as a longer one.
    """
    depths = F.sequence(F.lit(0), F.lit(DIRECTORY_BITS))
    nodes = (
        cells.select("cell", "keys", F.explode(depths).alias("depth"))
        .groupBy("depth", F.expr(f"shiftright(cell, {DIRECTORY_BITS} - depth)").alias("prefix"))
        .agg(F.sum("keys").alias("keys"))
    )
    split = nodes.where((F.col("keys") > capacity) & (F.col("depth") < DIRECTORY_BITS))
    # A node exists if its parent was split; it is a bucket if it was not split itself.
    children = split.select(
        (F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix")
    )
    zero = F.col("id").cast("int")
    root = cells.sparkSession.range(1).select(zero.alias("depth"), zero.alias("prefix"))
    buckets = children.unionByName(root).join(split.select("depth", "prefix"), ["depth", "prefix"], "left_anti")
    first = F.expr(f"shiftleft(prefix, {DIRECTORY_BITS} - depth)")
    last = F.expr(f"shiftleft(prefix + 1, {DIRECTORY_BITS} - depth) - 1")
    return buckets.select(F.explode(F.sequence(first, last)).alias("cell"), first.alias("bucket"), "depth")


def exact_groups(docs: DataFrame, capacity: int = BUCKET_KEYS) -> DataFrame:
    """Groups of equal texts: one row per row of ``docs`` (doc_id, text).

    Returns doc_id, keep_id, group_size, kept, text_sha256, n_chars.  Texts are
    equal if identical without white space; a null text counts as empty, and all
    empty texts are one group.  The row with the most code points stays, then
    the smallest doc_id (null is largest).  Rows that repeat the doc_id and
    length of the row that stays are all marked kept; ``drop_copies`` leaves one
    of them.  An empty table gives no rows.
    """
    text = text_of()
    pages = docs.select("doc_id", F.length(text).alias("n_chars"), without_white(text).alias("body"))
    pages = pages.withColumn("key", _key(F.col("body")))
    index = written(pages.select("doc_id", "n_chars", "key", F.sha2("body", 256).alias("text_sha256")), "dedup-index")

    keys = written(index.groupBy("key").agg(F.count(F.lit(1)).alias("copies")), "dedup-keys")
    cells = keys.groupBy(_cell(F.col("key")).alias("cell")).agg(F.count(F.lit(1)).alias("keys"))
    # 2^DIRECTORY_BITS rows at most.
    pointers = F.broadcast(written(directory(cells, capacity), "dedup-directory"))
    shared = keys.where("copies > 1").select("key")

    texts = likely_in(pages, "key", shared).withColumn("cell", _cell(F.col("key"))).join(pointers, "cell")
    chains = (
        texts.groupBy("bucket", "key", "body")
        .agg(F.count(F.lit(1)).alias("group_size"), F.max(_rank()).alias("best"))
        .where("group_size > 1")
    )
    groups = written(
        chains.select("key", F.sha2("body", 256).alias("text_sha256"), "group_size", _id_of(F.col("best")).alias("keep_id"),
                      ((F.col("best") - F.col("best") % _step()) / _step()).cast("int").alias("keep_chars")),
        "dedup-groups",
    )
    joined = lookup_join(index, groups, ["key", "text_sha256"], "group_size", "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars")))).alias("kept"),
        "text_sha256",
        "n_chars",
    )


def drop_copies(docs: DataFrame, capacity: int = BUCKET_KEYS) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with all their columns.

    Null texts are empty, and one of all empty texts stays.  Of rows that repeat
    doc_id and text one stays; a null doc_id counts as one of its own.  Columns
    of any names are kept but those that begin with two underscores, which are
    used here.  An empty table stays empty.
    """
    text = text_of()
    kept = exact_groups(docs, capacity).where("kept")
    names = kept.groupBy("doc_id", "text_sha256", "n_chars").agg((F.count(F.lit(1)) > 1).alias("__repeated"))
    names = names.select(
        F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"), F.col("n_chars").alias("__n"), "__repeated"
    )
    rows = docs.withColumns({"__s": F.sha2(without_white(text), 256), "__l": F.length(text)})
    rows = rows.join(
        names,
        F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__s") == F.col("__sha")) & (F.col("__l") == F.col("__n")),
    )
    once = rows.where("not __repeated").select(*docs.columns)
    again = rows.where("__repeated").dropDuplicates(["__id", "__sha", "__n"]).select(*docs.columns)
    return once.unionByName(again)


def exact_sql(table: str = "documents") -> str:
    """The rows of the query in DuckDB SQL."""
    return f"""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS body FROM {table}),
best AS (
  SELECT *, count(*) OVER (PARTITION BY body) AS group_size,
         first_value(doc_id) OVER (PARTITION BY body ORDER BY n_chars DESC, doc_id NULLS LAST) AS keep_id,
         max(n_chars) OVER (PARTITION BY body) AS most FROM rows)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND n_chars = most AS kept,
       sha256(body) AS text_sha256 FROM best"""
