"""Ingest of new snapshots as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import keys as K
from strata.operators import clean
from strata.sources import readers, sinks


def ingest_trec(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    language: str = "French",
    last_train: str = "2023-02",
    glob: str = "*.trec",
):
    """Parse files not seen before, deduplicate, and write their slices.

    Runs over what is there and stops.  The file source remembers processed
    files in ``checkpoint``, which must be on shared storage; a repeated batch
    gives the same slices, so a restart after a failure is harmless.
    """
    raw = (
        spark.readStream.format("text")
        .option("lineSep", "</DOC>")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(source)
    )
    rows = readers.parse_trec(
        raw.select("value", K.month_in_path(readers.MONTH_FOLDER).alias("date"))
    )
    tagged = rows.withColumn("language", F.lit(language)).withColumn(
        "split", K.split_of(F.col("date"), last_train)
    )

    def write(batch: DataFrame, _batch_id: int) -> None:
        merged = batch
        if readers.exists(batch.sparkSession, target):
            stored = batch.sparkSession.read.parquet(target)
            touched = batch.select("date").distinct()  # one row per slice
            merged = stored.join(F.broadcast(touched), "date", "left_semi").unionByName(batch)
        kept = clean.keep_smallest_hash(merged, ["split", "language", "date", "docid"])
        sinks.write_slices(kept, target, touched_only=True)

    return (
        tagged.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
