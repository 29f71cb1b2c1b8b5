"""Whole releases in their raw folder layouts, and the writers that no other query calls.

Every query writes whole tables below the shared folder in the layout that the
reader under test expects, and reads them back with it.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions import vectors as V
from strata.operators import stats
from strata.plans import tables as T
from strata.plans.io_queries import HASHED, hashed
from strata.plans.registry import query
from strata.session import scratch_path
from strata.sources import collections, readers, sinks
from strata.sources.collections import TestCollection, TrainCollection

# Documents whose numbers share all but the last two digits make a file.
PER_FILE = 100


def _file(docid: str = "docid"):
    return F.floor(F.substring(docid, 4, 20).cast("long") / PER_FILE).alias("file")


def plain_folders(spark, root: str, column: str) -> None:
    """Rename the folders ``column=value`` of a partitioned table to ``value``."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    pattern = hadoop(f"{root}/{column}=*")
    files = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.globStatus(pattern):
        old = status.getPath()
        files.rename(old, hadoop(old.getParent(), old.getName().split("=", 1)[1]))


def write_json_arrays(docs: DataFrame, root: str) -> None:
    """``<month>_fr`` folders of files that each hold an array of ``{id, contents}``, ordered by id."""
    record = F.struct(F.col("docid").alias("id"), "contents")
    files = docs.groupBy(
        F.concat("date", F.lit("_fr")).alias("month"), _file()
    ).agg(F.to_json(F.array_sort(F.collect_list(record))).alias("value"))
    # One file per array: a row is a whole file.
    files = files.repartition("month", "file")
    files.select("month", "value").write.option("maxRecordsPerFile", 1).partitionBy("month").text(root)
    plain_folders(files.sparkSession, root, "month")


@query("train_release", "S1 S5 S6", f"WITH {T.DOCS} {HASHED}, 'train' AS split, 'French' AS language FROM docs")
def train_release(spark, sf):
    path = scratch_path(spark, "train-release")
    write_json_arrays(T.documents(spark, sf), f"{path}/release/French/base/Json")
    docs = TrainCollection(spark, path).documents
    return docs.select("date", "docid", F.md5("contents").alias("text_hash"), "split", "language")


@query("test_release", "S1 S5 S7", f"WITH {T.DOCS} {HASHED}, 'test' AS split FROM docs")
def test_release(spark, sf):
    path = scratch_path(spark, "test-release")
    write_json_arrays(T.documents(spark, sf), f"{path}/The Test set/Json")
    docs = TestCollection(spark, path).documents
    return docs.select("date", "docid", F.md5("contents").alias("text_hash"), "split")


@query(
    "dev_sample",
    "S20",
    f"""WITH {T.DOCS}, placed AS (SELECT date, docid, contents, row_number() OVER (
      PARTITION BY date, CAST(substr(docid, 4) AS BIGINT) // {PER_FILE} ORDER BY docid) - 1 AS pos FROM docs)
    SELECT CAST(pos AS INTEGER) AS pos, docid, md5(contents) AS text_hash FROM placed WHERE pos < 3""",
)
def dev_sample(spark, sf):
    """The first three records of every file."""
    path = scratch_path(spark, "dev-sample")
    docs = T.documents(spark, sf)
    record = F.struct(F.col("docid").alias("id"), "contents")
    files = docs.groupBy("date", _file()).agg(
        F.to_json(F.array_sort(F.collect_list(record))).alias("value")
    )
    files.repartition("date", "file").select("date", "value").write.option("maxRecordsPerFile", 1).partitionBy("date").text(path)
    rows = readers.dev_sample(spark, path, 3, "*.txt")
    return rows.select("pos", "docid", F.md5("contents").alias("text_hash"))


@query("trec_slices", "S9 S11", f"WITH {T.DOCS} {HASHED} FROM docs WHERE date IN ('2022-07', '2023-01')")
def trec_slices(spark, sf):
    """Two requested slices of a release; the others are not read."""
    path = scratch_path(spark, "trec-release")
    record = F.concat(
        F.lit("<DOC>\n<DOCNO>"), "docid", F.lit("</DOCNO>\n<TEXT>\n"), "contents", F.lit("\n</TEXT>\n</DOC>")
    )
    lines = T.documents(spark, sf).select(F.concat("date", F.lit("_fr")).alias("month"), record.alias("value"))
    lines.write.partitionBy("month").text(f"{path}/Trec")
    plain_folders(spark, f"{path}/Trec", "month")
    every = readers.trec_slices(spark, path)
    wanted = [folder for folder in every if folder.endswith(("2022-07_fr", "2023-01_fr"))]
    return hashed(readers.trec_documents(spark, wanted, glob="*.txt"))


@query(
    "parquet_roots",
    "S18",
    f"WITH {T.DOCS} {HASHED} FROM docs UNION ALL SELECT role, docid, md5(contents) FROM (SELECT CAST(conv_id AS VARCHAR) AS docid, role, text AS contents FROM conversations)",
)
def parquet_roots(spark, sf):
    path = scratch_path(spark, "roots")
    for name, rows in (("a", T.documents(spark, sf)), ("b", T.records(spark, sf))):
        rows.select("date", "docid", "contents").write.parquet(f"{path}/{name}")
    return hashed(readers.parquet_roots(spark, f"{path}/a", f"{path}/b"))


@query("file_count", "K9", "SELECT 5 AS files, count(*) AS n FROM documents")
def file_count(spark, sf):
    path = scratch_path(spark, "files")
    sinks.write_files(T.documents(spark, sf), path, 5)
    rows = spark.read.parquet(path).select(F.col("_metadata.file_name").alias("f"))
    return rows.agg(F.count_distinct("f").cast("int").alias("files"), F.count(F.lit(1)).alias("n"))


@query(
    "summary_csv",
    "K6",
    f"WITH {T.DOCS}, {T.POSED}, {T.QRELS} SELECT CAST(rel AS VARCHAR) AS rel, CAST(count(*) AS VARCHAR) AS n FROM qrels GROUP BY rel",
)
def summary_csv(spark, sf):
    path = scratch_path(spark, "summary")
    sinks.write_summary(stats.grade_histogram(T.stored_qrels(spark, sf)), path)
    return spark.read.csv(path, header=True).select("rel", "n")


@query(
    "qrels_union",
    "U5",
    f"WITH {T.DOCS}, {T.POSED}, {T.QRELS} SELECT date, qid, docid, rel FROM qrels",
)
def qrels_union(spark, sf):
    """Judgements of the train and test slices, projected and stored by date."""
    path = scratch_path(spark, "qrels-union")
    judged = T.stored_qrels(spark, sf)
    train, test = judged.where(F.col("date") <= T.LAST_TRAIN), judged.where(F.col("date") > T.LAST_TRAIN)
    train.withColumn("split", F.lit("train")).unionByName(test, allowMissingColumns=True).select(
        "qid", "docid", "rel", "date"
    ).write.partitionBy("date").parquet(path)
    return spark.read.schema("qid string, docid string, rel int, date string").parquet(path)


@query(
    "vector_arrays",
    "P12",
    f"WITH {T.THETAS} SELECT docid, CAST(generate_subscripts(theta, 1) - 1 AS INTEGER) AS topic, round(unnest(theta), 6) AS share FROM thetas",
)
def vector_arrays(spark, sf):
    """ML vectors as arrays; arrays stay as they are."""
    vectors = T.topics(spark, sf).select("docid", array_to_vector("theta").alias("theta"))
    rows = V.as_array(V.as_array(vectors, "theta"), "theta")
    return rows.select("docid", F.posexplode("theta").alias("topic", "v")).select("docid", "topic", F.round("v", 6).alias("share"))


EVENTS = "SELECT strftime(ts, '%Y-%m') AS date, 'train' AS split, event_type AS arm, value FROM events"


def results(spark, sf) -> DataFrame:
    """The event stream read as results of runs: a type is an arm, every event a seed."""
    return T.table(spark, sf, "events").select(
        F.date_format("ts", "yyyy-MM").alias("date"), F.lit("train").alias("split"), F.col("event_type").alias("arm"), "value"
    )


@query("arm_throughput", "A30", f"SELECT arm, round(avg(value), 1) AS pairs_per_s FROM ({EVENTS}) GROUP BY arm")
def arm_throughput(spark, sf):
    return stats.throughput(results(spark, sf).withColumnRenamed("value", "pairs_per_s"))


@query(
    "seed_cells",
    "A23",
    f"SELECT date, split, arm, round(avg(value), 6) AS mean, round(stddev(value), 6) AS std, count(*) AS n_seeds FROM ({EVENTS}) GROUP BY date, split, arm",
)
def seed_cells(spark, sf):
    rows = stats.seed_cells(results(spark, sf), "value")
    return rows.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query(
    "web_queries",
    "S12",
    f"""WITH {T.DOCS}, {T.POSED}, {T.QRELS}, dates AS (SELECT DISTINCT date FROM qrels)
    SELECT date, qid, docid, rel, md5(regexp_replace(query, '\\s+', ' ', 'g')) AS query_hash
    FROM qrels JOIN posed USING (qid)""",
)
def web_queries(spark, sf):
    """Queries and judgements below two roots; the month comes from a file's and a folder's name."""
    queries, judged = scratch_path(spark, "web"), scratch_path(spark, "web-qrels")
    months = T.stored_qrels(spark, sf).select("date", "qid").distinct()
    line = F.concat_ws("\t", "qid", F.regexp_replace("query", r"\s+", " "))
    posed = months.join(T.queries(spark, sf).select("qid", line.alias("value")), "qid")
    posed.select("value", F.concat("date", F.lit("_queries")).alias("m")).repartition("m").write.partitionBy("m").text(f"{queries}/raw")
    _month_files(spark, f"{queries}/raw", f"{queries}/queries")
    rows = T.stored_qrels(spark, sf).select(
        F.concat("date", F.lit("_fr")).alias("month"),
        F.concat_ws(" ", "qid", F.lit("0"), "docid", F.col("rel").cast("string")).alias("value"),
    )
    rows.repartition("month").write.partitionBy("month").text(judged)
    collection = collections.TrecCollection(spark, queries)
    rels = collection.qrels_from(judged, "*.txt").select("date", "qid", "docid", "rel")
    texts = collection.queries.select("date", "qid", F.md5("query").alias("query_hash"))
    return rels.join(texts, ["date", "qid"])


def _month_files(spark, source: str, target: str) -> None:
    """Files below folders ``m=<name>`` as files ``<name>.txt`` of one folder, as the collection has them."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    pattern = hadoop(f"{source}/m=*/part-*")
    files = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(hadoop(target))
    for status in files.globStatus(pattern):
        old = status.getPath()
        files.rename(old, hadoop(f"{target}/{old.getParent().getName()[2:]}.txt"))
