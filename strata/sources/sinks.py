"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

SLICE = ["split", "language", "date"]


def write_slices(
    df: DataFrame,
    path: str,
    by: list[str] | None = None,
    touched_only: bool = False,
    rebalance: bool = False,
) -> None:
    """Parquet partitioned by slice; ``touched_only`` leaves other slices in place.

    ``rebalance`` gathers the rows of a slice into few files at the price of a
    shuffle; a large slice is still split over several tasks.
    """
    columns = by or SLICE
    rows = df.hint("rebalance", *columns) if rebalance else df
    mode = "dynamic" if touched_only else "static"
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", mode)
        .partitionBy(*columns)
        .parquet(path)
    )


def write_json(docs: DataFrame, path: str) -> None:
    """One JSON object ``{id, contents}`` per line."""
    docs.select(F.col("docid").alias("id"), "contents").write.mode("overwrite").json(path)


def write_run(rows: DataFrame, path: str, require_rows: bool = False) -> None:
    """Run files: tab-separated, gzipped, one folder per date, ordered by query and rank.

    Rows are range-partitioned, so a large slice is written by several tasks
    whose files follow one another in order.  They are counted while they are
    written; an empty run is an error if ``require_rows``.
    """
    columns = ["qid", "Q0", "docno", "rank", "score", "tag"]
    counted = Observation("run rows")
    (
        rows.select("date", *columns)
        .repartitionByRange("date", "qid", "rank")
        .sortWithinPartitions("date", "qid", "rank")
        .observe(counted, F.count(F.lit(1)).alias("n"))
        .write.mode("overwrite")
        .partitionBy("date")
        .csv(path, sep="\t", header=False, compression="gzip")
    )
    if require_rows and not counted.get["n"]:
        raise ValueError("the run is empty")


def read_run(spark, path: str) -> DataFrame:
    return spark.read.csv(
        path, sep="\t", schema="qid string, Q0 string, docno string, rank int, score double, tag string, date string"
    )


def write_summary(df: DataFrame, path: str) -> None:
    """Small summary table as CSV with a header."""
    df.write.mode("overwrite").csv(path, header=True)


def write_files(df: DataFrame, path: str, files: int) -> None:
    """Parquet in a given number of files."""
    df.repartition(files).write.mode("overwrite").parquet(path)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)
