"""Collections: documents, queries and judgements behind one interface."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import keys as K
from strata.operators import clean
from strata.sources import readers, sinks


class Collection:
    """Base: raw folder ``<split>/<language>/<date>`` with fixed metadata."""

    split = "train"
    language = "French"

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    @property
    def metadata(self) -> dict[str, str]:
        split, language, date = self.path.split("/")[-3:]
        return {"language": language, "date": date, "split": split}

    def _tag(self, df: DataFrame) -> DataFrame:
        return df.withColumn("language", F.lit(self.language)).withColumn("split", F.lit(self.split))

    @property
    def documents(self) -> DataFrame:
        return readers.json_documents(self.spark, f"{self.path}/Json/*")

    @property
    def queries(self) -> DataFrame:
        return readers.queries_tsv(self.spark, f"{self.path}/queries")

    @property
    def qrels(self) -> DataFrame | None:
        return readers.qrels_if_present(self.spark, f"{self.path}/qrels")

    def to_parquet(self, path: str) -> None:
        sinks.write_slices(self.documents, f"{path}/Documents")
        sinks.write_slices(self.queries, f"{path}/Queries")
        if self.qrels is not None:
            sinks.write_slices(self.qrels, f"{path}/Qrels")


class TrainCollection(Collection):
    """Release folder of the training months."""

    @property
    def metadata(self) -> dict[str, str]:
        return {"language": self.language, "split": self.split, "date": "multiple"}

    @property
    def documents(self) -> DataFrame:
        return self._tag(readers.json_documents(self.spark, f"{self.path}/*/French/*/Json/*/*"))

    @property
    def queries(self) -> DataFrame:
        return self._tag(readers.queries_tsv(self.spark, f"{self.path}/*/French/*/queries/*"))

    @property
    def qrels(self) -> DataFrame | None:
        files = readers.qrels(
            self.spark, f"{self.path}/*/French/*/qrels/*", date=readers.file_month()
        )
        return self._tag(files)


class TestCollection(Collection):
    """Release folder of the test months; judgements are published elsewhere."""

    __test__ = False
    split = "test"

    @property
    def metadata(self) -> dict[str, str]:
        return {"language": self.language, "split": self.split, "date": "multiple"}

    @property
    def documents(self) -> DataFrame:
        return self._tag(readers.json_documents(self.spark, f"{self.path}/*Test*/Json/*/*"))

    @property
    def queries(self) -> DataFrame:
        return self._tag(readers.queries_tsv(self.spark, f"{self.path}/*Test*/queries/*"))

    @property
    def qrels(self) -> DataFrame | None:
        raise NotImplementedError("the test release holds no judgements")

    def to_parquet(self, path: str) -> None:
        sinks.write_slices(self.documents, f"{path}/Documents")
        sinks.write_slices(self.queries, f"{path}/Queries")


class ParquetCollection(Collection):
    """Collection written by :meth:`Collection.to_parquet`."""

    @property
    def documents(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/Documents")

    @property
    def queries(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/Queries")

    @property
    def qrels(self) -> DataFrame | None:
        path = f"{self.path}/Qrels"
        return self.spark.read.parquet(path) if readers.exists(self.spark, path) else None


class TrecCollection(Collection):
    """Markup files below ``Trec/<month>_fr``, plain or under a compressed file's name."""

    def __init__(self, spark, path, dates: list[str] | None = None, split: str = "train"):
        super().__init__(spark, path)
        self.dates = dates
        self.split = split

    @property
    def documents(self) -> DataFrame:
        slices = readers.trec_slices(self.spark, self.path, self.dates)
        frames = [
            readers.trec_documents(self.spark, slices),
            readers.trec_documents_misnamed(self.spark, slices),
        ]
        return self._tag(clean.union_all(frames))

    @property
    def queries(self) -> DataFrame:
        rows = self.spark.read.csv(
            f"{self.path}/queries/*_queries.txt", sep="\t", schema=readers.QUERY, quote=""
        ).withColumn("date", K.month_in_path(readers.MONTH_FILE))
        return self._tag(rows if not self.dates else rows.where(F.col("date").isin(self.dates)))

    @property
    def qrels(self) -> DataFrame | None:
        return self.qrels_from(f"{self.path}/qrels")

    def qrels_from(self, root: str, name: str = "qrels_processed.txt") -> DataFrame:
        """Judgements ``<month>[_fr]/<name>`` below any root."""
        rows = readers.qrels(self.spark, f"{root}/*/{name}")
        return self._tag(rows if not self.dates else rows.where(F.col("date").isin(self.dates)))

    def to_parquet(self, path: str, qrels_root: str | None = None) -> None:
        """Deduplicated documents, queries and judgements; only touched slices are replaced."""
        kept = clean.keep_smallest_hash(self.documents, ["split", "language", "date", "docid"])
        sinks.write_slices(kept, f"{path}/Documents", touched_only=True)
        sinks.write_slices(self.queries, f"{path}/Queries", touched_only=True)
        judged = self.qrels_from(qrels_root) if qrels_root else self.qrels
        sinks.write_slices(judged, f"{path}/Qrels", touched_only=True)
