"""Round trips of the given tables through the raw formats and the writers.

Every query writes the whole table below the shared folder in a raw format and
reads it back with the reader under test.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.operators import retrieval
from strata.plans import retrieval_queries as R
from strata.plans import tables as T
from strata.plans.registry import query
from strata.session import scratch_path
from strata.sources import readers, sinks

HASHED = "SELECT date, docid, md5(contents) AS text_hash"


def hashed(df):
    return df.select("date", "docid", F.md5("contents").alias("text_hash"))


def _trec_lines(docs):
    """Documents as marked-up records, with the folder of their slice."""
    record = F.concat(
        F.lit("<DOC>\n<DOCNO>"), "docid", F.lit("</DOCNO>\n<TEXT>\n"), "contents", F.lit("\n</TEXT>\n</DOC>")
    )
    return docs.select(F.concat("date", F.lit("_fr")).alias("month"), record.alias("value"))


TREC = rf"""WITH {T.DOCS} SELECT date, docid, md5(regexp_replace(contents, '^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$', '', 'g')) AS text_hash FROM docs"""


@query("trec_parse", "S9", TREC)
def trec_parse(spark, sf):
    path = scratch_path(spark, "trec")
    _trec_lines(T.documents(spark, sf)).write.partitionBy("month").text(path)
    return hashed(readers.trec_documents(spark, path, glob="*.txt"))


@query("trec_misnamed", "S10", TREC)
def trec_misnamed(spark, sf):
    """Plain markup in files that carry a compressed file's name, several a month."""
    path = scratch_path(spark, "trec-raw")
    _trec_lines(T.documents(spark, sf)).write.partitionBy("month").text(path)
    _rename(spark, f"{path}/*/*.txt", ".jsonl.gz")
    return hashed(readers.trec_documents_misnamed(spark, path))


def _rename(spark, glob: str, suffix: str) -> None:
    """Give files that this query wrote another ending."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    pattern = hadoop(glob)
    files = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.globStatus(pattern):
        old = status.getPath()
        files.rename(old, hadoop(old.getParent(), old.getName().replace(".txt", suffix)))


@query("json_export", "K3", f"WITH {T.DOCS} SELECT docid, md5(contents) AS text_hash FROM docs")
def json_export(spark, sf):
    path = scratch_path(spark, "json")
    sinks.write_json(T.documents(spark, sf), path)
    rows = spark.read.schema(readers.DOCUMENT).json(path)
    return rows.select(F.col("id").alias("docid"), F.md5("contents").alias("text_hash"))


@query(
    "slice_store",
    "K1 K2 S8 D1 P1",
    f"WITH {T.DOCS} {HASHED}, split, language FROM docs WHERE date <> '2022-07' "
    f"UNION ALL {HASHED}, split, language FROM docs WHERE date = '2022-07' AND length(contents) > 1000",
)
def slice_store(spark, sf):
    """Write all slices, then replace a single one."""
    path = scratch_path(spark, "slices")
    docs = T.documents(spark, sf)
    sinks.write_slices(docs, path, rebalance=True)
    again = docs.where((F.col("date") == "2022-07") & (F.length("contents") > 1000))
    sinks.write_slices(again, path, touched_only=True)
    stored = spark.read.parquet(path)
    return stored.select("date", "docid", F.md5("contents").alias("text_hash"), "split", "language")


@query(
    "query_tsv",
    "S2 D2",
    f"""WITH {T.POSED} SELECT qid, md5(regexp_replace(query, '\\s+', ' ', 'g')) AS query_hash FROM posed""",
)
def query_tsv(spark, sf):
    path = scratch_path(spark, "tsv")
    line = F.concat_ws("\t", "qid", F.regexp_replace("query", r"\s+", " "))
    T.queries(spark, sf).select(line).write.text(path)
    return readers.queries_tsv(spark, path).select("qid", F.md5("query").alias("query_hash"))


@query(
    "qrels_file",
    "S3 S13",
    f"WITH {T.DOCS}, {T.POSED}, {T.QRELS} SELECT date, qid, docid, rel FROM qrels",
)
def qrels_file(spark, sf):
    path = scratch_path(spark, "qrels")
    rows = T.stored_qrels(spark, sf).select(
        F.concat("date", F.lit("_fr")).alias("month"),
        F.concat_ws(" ", "qid", F.lit("0"), "docid", F.col("rel").cast("string")).alias("value"),
    )
    rows.repartition("month").write.partitionBy("month").text(path)
    return readers.qrels(spark, path).select("date", "qid", "docid", "rel")


@query(
    "run_files",
    "K4 K5 W4",
    f"""WITH {T.RUN} SELECT date, qid, docid AS docno,
    CAST(row_number() OVER (PARTITION BY date, qid ORDER BY score DESC, docid) AS INTEGER) AS rank, score FROM run""",
)
def run_files(spark, sf):
    path = scratch_path(spark, "runs")
    rows = retrieval.submission(T.run(spark, sf), ["date", "qid"], "strata_bm25")
    sinks.write_run(rows, path, require_rows=True)
    return sinks.read_run(spark, path).select(
        F.col("date").cast("string").alias("date"), "qid", "docno", "rank", "score"
    )


@query(
    "expansion_file",
    "S15 D18",
    f"""WITH {R.NEW_TERMS} SELECT qid, md5(query) AS original_hash, (SELECT count(*) FROM uniq u WHERE u.qid = posed.qid AND r <= {R.MAX_TERMS}) AS n_terms FROM posed""",
)
def expansion_file(spark, sf):
    path = scratch_path(spark, "expansions")
    merged = retrieval.merge_expansion(R.with_terms(spark, sf), R.MAX_TERMS, R.WEIGHT)
    batch = F.floor(F.col("qid").cast("long") / 100).alias("batch")
    records = F.collect_list(F.struct("qid", "query", "terms", "original"))
    batches = merged.groupBy(batch).agg(F.to_json(records).alias("value")).repartition("batch")
    batches.select("value").write.option("maxRecordsPerFile", 1).text(path)
    rows = readers.expansions(spark, path)
    return rows.select("qid", F.md5("original").alias("original_hash"), F.size("terms").cast("bigint").alias("n_terms"))


@query(
    "batch_results",
    "S19",
    rf"""SELECT CAST(conv_id AS VARCHAR) AS query_id, count(*) AS n, max(md5(p[1])) AS first_hash, max(md5(p[5])) AS fifth_hash, CAST(sum(len(p)) AS BIGINT) AS n_results,
    max(md5(array_to_string(p, '|'))) AS all_hash FROM (
    SELECT conv_id, regexp_split_to_array(text, '[.,\n]+') AS p FROM conversations) GROUP BY conv_id""",
)
def batch_results(spark, sf):
    """Conversations as batch-response lines, one payload of pieces per turn."""
    path = scratch_path(spark, "batch")
    payload = F.to_json(F.struct(F.split("text", r"[.,\n]+").alias("results")))
    message = F.struct(F.struct(payload.alias("content")).alias("message"))
    T.table(spark, sf, "conversations").select(
        F.concat(F.lit("request-"), "conv_id").alias("custom_id"),
        F.struct(F.struct(F.array(message).alias("choices")).alias("body")).alias("response"),
    ).write.json(path)
    rows = readers.batch_results(spark, path)
    return rows.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.md5("expansion1")).alias("first_hash"),
        F.max(F.md5("expansion5")).alias("fifth_hash"),
        F.sum(F.size("results")).alias("n_results"),
        F.max(F.md5(F.array_join("results", "|"))).alias("all_hash"),
    )


@query(
    "rerank_csv",
    "S16",
    f"WITH {T.RUN} SELECT qid, docid, score, CAST(rank AS INTEGER) AS rerank_rank FROM run",
)
def rerank_csv(spark, sf):
    path = scratch_path(spark, "reranked")
    T.run(spark, sf).select(
        "qid", "docid", F.col("score").alias("rerank_score"), F.col("rank").alias("rerank_rank")
    ).write.csv(path, header=True)
    return readers.reranked(spark, path)


@query(
    "topics_file",
    "S14",
    r"""SELECT CAST(item_id AS VARCHAR) AS qid, md5(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g')) AS query_hash, item_id AS "order" FROM benchmark""",
)
def topics_file(spark, sf):
    path = scratch_path(spark, "topics")
    text = F.trim(F.regexp_replace("query", r"\s+", " "))
    T.queries(spark, sf).select(
        F.concat(F.lit("<top>\n<num>"), "qid", F.lit("</num>\n<title>"), text, F.lit("</title>\n</top>"))
    ).write.text(path)
    rows = readers.topics_file(spark, path)
    return rows.select("qid", F.md5("query").alias("query_hash"), "order")


@query("stored_models", "K7 T20")
def stored_models(spark, sf):
    """Vocabulary and topic model saved, loaded and applied."""
    from pyspark.ml.clustering import LocalLDAModel
    from pyspark.ml.feature import CountVectorizerModel

    from strata.functions import vectors as V
    from strata.operators import topics
    from strata.plans import topic_queries as P

    path = scratch_path(spark, "models")
    sinks.save_model(P.features(spark, sf)[0], f"{path}/vocabulary")
    sinks.save_model(P.lda(spark, sf, 4), f"{path}/lda")
    vocabulary = CountVectorizerModel.load(f"{path}/vocabulary")
    model = LocalLDAModel.load(f"{path}/lda")
    known = topics.vectorise(P.phrased(spark, sf), vocabulary)
    return V.spread(topics.infer(model, known, P.DOC), "theta", 4)


DELIVERED = rf"""WITH {T.DOCS}, told AS (
  SELECT date, docid, regexp_replace(contents, '^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$', '', 'g') AS body,
         regexp_replace(contents, '^[ \t\n\x0b\f\r]+', '') || ' early' AS early, CAST(substr(docid, 4) AS BIGINT) AS i FROM docs)
SELECT date, docid, md5(CASE WHEN i % 3 = 0 AND sha256(early) < sha256(body) THEN early ELSE body END) AS text_hash FROM told WHERE length(body) > 0"""


@query("stream_ingest", "Z1 K2", DELIVERED)
def stream_ingest(spark, sf):
    """Every slice arrives in two deliveries that share a third of the documents, with other texts."""
    from strata.streaming.ingest import ingest_trec

    root = scratch_path(spark, "stream")
    docs = T.documents(spark, sf)
    number = F.substring("docid", 4, 20).cast("long")
    twice = number % 3 == 0
    for early in (True, False):
        told = F.when(twice, F.concat("contents", F.lit(" early"))).otherwise(F.col("contents")) if early else F.col("contents")
        part = docs.where(twice | (number % 2 == (0 if early else 1))).withColumn("contents", told)
        _trec_lines(part).write.mode("append").partitionBy("month").text(f"{root}/source")
        ingest_trec(spark, f"{root}/source", f"{root}/target", f"{root}/progress", glob="*.txt").awaitTermination()
    return hashed(spark.read.parquet(f"{root}/target"))
