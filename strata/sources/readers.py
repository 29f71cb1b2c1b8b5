"""Readers for raw collections, query and judgement files, and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import keys as K
from strata.sources import ranges

DOCUMENT = "id string, contents string"
QUERY = "qid string, query string"
QRELS = "qid string, rank int, docid string, rel int"
EXPANSION = "qid string, query string, terms array<string>, original string"
RERANKED = "qid string, docid string, rerank_score double, rerank_rank int"

MONTH_FOLDER = r"[/=](\d{4}-\d{2})_[a-z]+/"
MONTH_FILE = r"[/=](\d{4}-\d{2})_queries"
MONTH_PARENT = r"[/=](\d{4}-\d{2})(?:_[a-z]+)?/[^/]*$"


def folder_month() -> Column:
    """Month of the last folder that is not a shard collection."""
    parts = F.split(F.col("_metadata.file_path"), "/")
    folders = F.filter(
        F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: ~F.lower(p).contains("collection")
    )
    return F.element_at(F.split(F.element_at(folders, -1), "_"), 1)


def file_month() -> Column:
    return F.element_at(F.split(K.path_part(1), "_"), 1)


def path_metadata(df: DataFrame) -> DataFrame:
    """Language, date and split of the file path ``.../<split>/<language>/<date>/<file>``."""
    return df.select(
        "*",
        K.path_part(4).alias("split"),
        K.path_part(3).alias("language"),
        K.path_part(2).alias("date"),
    )


def json_documents(spark: SparkSession, path) -> DataFrame:
    """Files that each hold an array of ``{id, contents}`` objects."""
    raw = spark.read.schema(DOCUMENT).json(path, multiLine=True)
    return raw.withColumnRenamed("id", "docid").withColumn("date", folder_month())


def queries_tsv(spark: SparkSession, path) -> DataFrame:
    raw = spark.read.csv(path, sep="\t", schema=QUERY, quote="")
    return raw.withColumn("date", file_month())


def qrels(spark: SparkSession, path, date: Column | None = None) -> DataFrame:
    """Space-separated judgements; the date is the month of the parent folder."""
    raw = spark.read.csv(path, sep=" ", schema=QRELS)
    return raw.withColumn("date", K.month_in_path(MONTH_PARENT) if date is None else date)


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop))


def remove(spark: SparkSession, glob: str) -> None:
    """Delete the files and folders that a pattern names."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(glob)
    files = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.globStatus(pattern) or []:
        files.delete(status.getPath(), True)


def qrels_if_present(spark: SparkSession, path: str) -> DataFrame | None:
    return qrels(spark, path) if exists(spark, path) else None


# --- TREC markup -----------------------------------------------------------------------


BLANKS = " \t\n\x0b\f\r"


def _after(column: str, tag: str) -> Column:
    """What follows the first opening tag; empty if there is none."""
    at = F.locate(f"<{tag}>", F.col(column))
    rest = F.expr(f"substr({column}, locate('<{tag}>', {column}) + {len(tag) + 2})")
    return F.when(at > 0, rest).otherwise("")


def parse_trec(records: DataFrame, column: str = "value") -> DataFrame:
    """``docid, contents`` of TREC records; records without either are dropped.

    A record is cut at its tags; an unclosed text runs to the record's end.  The
    fields are made inside a generator, so that the filters on them are not
    pushed down and do not cut the record a second time.
    """
    name, body = _after(column, "DOCNO"), _after(column, "TEXT")
    closed = F.contains(name, F.lit("</DOCNO>"))
    fields = F.struct(
        F.when(closed, F.substring_index(name, "</DOCNO>", 1)).otherwise("").alias("docid"),
        F.btrim(F.substring_index(body, "</TEXT>", 1), F.lit(BLANKS)).alias("contents"),
    )
    rest = [c for c in records.columns if c != column]
    rows = records.select(*rest, F.inline(F.array(fields)))
    kept = rows.where((F.col("docid") != "") & (F.length("contents") > 0))
    return kept.select("docid", "contents", *rest)


def trec_documents(spark: SparkSession, path, glob: str = "*.trec", dates: list[str] | None = None) -> DataFrame:
    """Documents of TREC files below ``path``.  Records are split while reading,
    so one large file is spread over many tasks."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(
        path, lineSep="</DOC>"
    )
    rows = parse_trec(raw.select("value", K.month_in_path(MONTH_FOLDER).alias("date")))
    return rows if not dates else rows.where(F.col("date").isin(dates))


def trec_documents_misnamed(
    spark: SparkSession, path, glob: str = "*.jsonl.gz", range_bytes: int = ranges.RANGE_BYTES
) -> DataFrame:
    """Plain-text TREC files under a compressed file's name.

    Bytes are read without a codec, by ranges, so one large file is spread over
    many tasks."""
    raw = ranges.read_records(spark, path, glob, "</DOC>", range_bytes=range_bytes)
    return parse_trec(raw.select("value", F.regexp_extract("path", MONTH_FOLDER, 1).alias("date")))


def trec_slices(spark: SparkSession, root: str, dates: list[str] | None = None) -> list[str]:
    """Slice folders of a collection: the requested months or every month found."""
    if dates:
        return [f"{root}/Trec/{d}_fr" for d in dates]
    glob = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/Trec/*_fr")
    found = glob.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(glob) or []
    return sorted(s.getPath().toString() for s in found)


def topics_file(spark: SparkSession, path) -> DataFrame:
    """``qid, query`` of ``<num>..</num><title>..</title>`` topics.

    The first text of a qid wins; rows carry an integer order key."""
    raw = spark.read.text(path, wholetext=True)
    text = F.col("value")
    pattern = r"(?s)<num>(.*?)</num>\s*<title>(.*?)</title>"
    pairs = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("qid"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("query"),
    )
    rows = raw.select(K.path_part(1).alias("file"), F.posexplode(pairs).alias("pos", "p")).select(
        "file", "pos", F.trim("p.qid").alias("qid"), F.trim("p.query").alias("query")
    )
    first = rows.groupBy("qid").agg(F.min_by("query", F.struct("file", "pos")).alias("query"))
    return first.withColumn("order", F.col("qid").try_cast("bigint"))


# --- expansions, scores, logs -----------------------------------------------------------


def expansions(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema(EXPANSION).json(path, multiLine=True)


def batch_results(spark: SparkSession, path, most: int = 5) -> DataFrame:
    """Batch-response lines to ``query_id, results``; malformed payloads are skipped.

    The first ``most`` results also stand in columns of their own, ``expansion1 ..``.
    """
    raw = spark.read.schema(
        "custom_id string, response struct<body:struct<choices:array<struct<message:struct<content:string>>>>>"
    ).json(path)
    payload = F.from_json(
        F.get(F.col("response.body.choices"), F.lit(0))["message"]["content"], "results array<string>"
    )
    rows = raw.select(
        F.get(F.split("custom_id", "-"), F.lit(1)).alias("query_id"), payload["results"].alias("r")
    ).where(F.col("r").isNotNull())
    return rows.select(
        "query_id", F.col("r").alias("results"), *[F.get("r", F.lit(i)).alias(f"expansion{i + 1}") for i in range(most)]
    )


def reranked(spark: SparkSession, path) -> DataFrame:
    rows = spark.read.csv(path, header=True, schema=RERANKED)
    return rows.withColumnRenamed("rerank_score", "score")


GPU_PROCESS = "pid string, process_name string, used_memory string, compute_instance_id string, gpu_instance_id string, type string"
GPU_LOG = (
    "nvidia_smi_log struct<timestamp:string, gpu:struct<product_name:string,"
    "utilization:struct<gpu_util:string,memory_util:string>,"
    f"processes:struct<process_info:array<struct<{GPU_PROCESS.replace(' string', ':string')}>>>>>"
)


def gpu_log(spark: SparkSession, path) -> DataFrame:
    """Nested monitoring events; the time string becomes unix seconds."""
    raw = spark.read.schema(GPU_LOG).json(path)
    log = F.col("nvidia_smi_log")
    stamp = F.regexp_replace(F.substring(log["timestamp"], 5, 100), r"\s+", " ")
    return raw.select(
        F.unix_timestamp(stamp, "MMM d HH:mm:ss yyyy").alias("timestamp"),
        log["gpu"]["product_name"].alias("product_name"),
        log["gpu"]["utilization"].alias("utilization"),
        log["gpu"]["processes"]["process_info"].alias("process_info"),
    )


def parquet_roots(spark: SparkSession, *roots: str) -> DataFrame:
    return spark.read.parquet(*roots)


# Where a record of a JSON array starts.  Inside a string the quote would be escaped, so this is no text.
JSON_RECORD = r'\{\s{0,64}"(?:id|contents)"'


def json_array_documents(spark: SparkSession, path, glob: str = "*.json", most: int = 0, range_bytes: int = ranges.RANGE_BYTES) -> DataFrame:
    """``file, start, pos, docid, contents`` of files that hold one JSON array of documents.

    The arrays are read by byte ranges, so files may have any size.  ``start``
    and ``pos`` order the records of a file; with ``most`` only its first records
    are read.  TREC folders and URL lists are skipped.
    """
    raw = ranges.read_records(
        spark, path, glob, JSON_RECORD, at_match=True, range_bytes=range_bytes, most=most, skip=r"(?i:trec)|urls\.json"
    )
    # What stands between two records is cut off.
    record = F.from_json(F.regexp_replace("value", r"[\s,\]]+$", ""), DOCUMENT)
    rows = raw.select(F.col("path").alias("file"), "start", "pos", record.alias("r"))
    return rows.select("file", "start", "pos", F.col("r.id").alias("docid"), "r.contents")


def dev_sample(spark: SparkSession, path, n: int = 10, glob: str = "*.json") -> DataFrame:
    """First ``n`` records of every JSON array file, in file order; no more of a file is read.

    TREC folders and URL lists are skipped."""
    return json_array_documents(spark, path, glob, most=n).drop("start")
