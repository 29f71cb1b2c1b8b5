"""Readers, writers, collections and streaming ingest on small files."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from strata.operators import clean
from strata.sources import readers, sinks
from strata.sources.collections import (
    Collection,
    ParquetCollection,
    TestCollection,
    TrainCollection,
    TrecCollection,
)
from strata.streaming.ingest import ingest_trec


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return path


def doc(docid, text, closed=True):
    return f"<DOC>\n<DOCNO>{docid}</DOCNO>\n<TEXT>\n{text}\n" + ("</TEXT>\n</DOC>\n" if closed else "")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_trec_records(spark, tmp_path):
    put(tmp_path / "Trec/2022-06_fr/a.trec", doc("doc1", "un  deux\ntrois") + doc("", "no number") + doc("doc2", "") + doc("doc3", "cut off", closed=False))
    put(tmp_path / "Trec/2022-07_fr/collection/b.trec", doc("doc1", "autre"))
    got = rows(readers.trec_documents(spark, str(tmp_path / "Trec")), "date", "docid", "contents")
    assert got == [
        ("2022-06", "doc1", "un  deux\ntrois"),
        ("2022-06", "doc3", "cut off"),
        ("2022-07", "doc1", "autre"),
    ]


def test_plain_text_under_a_gzip_name(spark, tmp_path):
    put(tmp_path / "Trec/2023-02_fr/x/c.jsonl.gz", doc("doc5", "été") + doc("doc6", "z"))
    got = rows(readers.trec_documents_misnamed(spark, str(tmp_path / "Trec")), "date", "docid", "contents")
    assert got == [("2023-02", "doc5", "été"), ("2023-02", "doc6", "z")]


def test_trec_collection_to_parquet(spark, tmp_path):
    root = tmp_path / "Train"
    put(root / "Trec/2022-06_fr/a.trec", doc("doc1", "b text") + doc("doc1", "a text") + doc("doc2", "other"))
    put(root / "Trec/2023-02_fr/c.jsonl.gz", doc("doc1", "later"))
    put(root / "queries/2022-06_queries.txt", "q1\tfirst \"query\"\n")
    put(root / "queries/2023-02_queries.txt", "q1\tfirst \"query\"\nq2\tsecond\n")
    put(root / "qrels/2022-06_fr/qrels_processed.txt", "q1 0 1 2\n")
    TrecCollection(spark, str(root)).to_parquet(str(tmp_path / "out"))
    stored = ParquetCollection(spark, str(tmp_path / "out"))
    assert rows(stored.documents, "date", "docid") == [("2022-06", "doc1"), ("2022-06", "doc2"), ("2023-02", "doc1")]
    kept = stored.documents.where("date = '2022-06' and docid = 'doc1'").select(F.sha2("contents", 256)).first()[0]
    want = spark.createDataFrame([("a text",), ("b text",)], "t string").select(F.min(F.sha2("t", 256))).first()[0]
    assert kept == want
    assert rows(stored.queries, "date", "qid", "query") == [
        ("2022-06", "q1", 'first "query"'), ("2023-02", "q1", 'first "query"'), ("2023-02", "q2", "second"),
    ]
    assert rows(stored.qrels, "date", "qid", "docid", "rel") == [("2022-06", "q1", "1", 2)]
    # A run over one slice replaces that slice only.
    put(root / "Trec/2023-02_fr/c.jsonl.gz", doc("doc9", "new"))
    TrecCollection(spark, str(root), dates=["2023-02"]).to_parquet(str(tmp_path / "out"))
    again = ParquetCollection(spark, str(tmp_path / "out")).documents
    assert rows(again, "date", "docid") == [("2022-06", "doc1"), ("2022-06", "doc2"), ("2023-02", "doc9")]


def test_json_collections(spark, tmp_path):
    train = tmp_path / "raw/release/French/base"
    put(train / "Json/2022-06_fr/collection_1.json", json.dumps([{"id": "doc1", "contents": "one"}, {"id": "doc2", "contents": "two"}]))
    put(train / "queries/2022-06_queries.txt", "q1\task\n")
    put(train / "qrels/2022-06_qrels.txt", "q1 0 1 1\n")
    made = TrainCollection(spark, str(tmp_path / "raw"))
    assert made.metadata["date"] == "multiple"
    assert rows(made.documents, "docid", "date", "split", "language") == [
        ("doc1", "2022-06", "train", "French"), ("doc2", "2022-06", "train", "French"),
    ]
    assert rows(made.queries, "qid", "query", "date") == [("q1", "ask", "2022-06")]
    assert rows(made.qrels, "qid", "docid", "rel", "date") == [("q1", "1", 1, "2022-06")]
    made.to_parquet(str(tmp_path / "pq"))
    assert ParquetCollection(spark, str(tmp_path / "pq")).documents.count() == 2

    put(tmp_path / "rel/My Test set/Json/2023-03_fr/x.json", json.dumps([{"id": "doc7", "contents": "t"}]))
    test = TestCollection(spark, str(tmp_path / "rel"))
    assert rows(test.documents, "docid", "date", "split") == [("doc7", "2023-03", "test")]
    with pytest.raises(NotImplementedError):
        test.qrels


def test_missing_qrels_and_metadata(spark, tmp_path):
    base = Collection(spark, str(tmp_path / "train/French/2022-06"))
    assert base.qrels is None
    assert base.metadata == {"split": "train", "language": "French", "date": "2022-06"}


def test_topics_first_text_wins(spark, tmp_path):
    text = "<num> 12 </num>\n<title> a title </title>\n<num>3</num><title>b</title><num>12</num><title>again</title>"
    put(tmp_path / "topics.trec", text)
    got = readers.topics_file(spark, str(tmp_path / "topics.trec")).orderBy("order").collect()
    assert [(r["qid"], r["query"]) for r in got] == [("3", "b"), ("12", "a title")]


def test_batch_results_skip_malformed(spark, tmp_path):
    def line(cid, content):
        return json.dumps({"custom_id": cid, "response": {"body": {"choices": [{"message": {"content": content}}]}}})

    put(tmp_path / "b.jsonl", "\n".join([
        line("request-7", json.dumps({"results": ["a", "b", "c", "d", "e", "f"]})),
        line("request-8", "not json"),
        line("request-9", json.dumps({"results": ["only"]})),
    ]))
    got = rows(readers.batch_results(spark, str(tmp_path)), "query_id", "expansion1", "expansion5")
    assert got == [("7", "a", "e"), ("9", "only", None)]


def test_expansions_and_reranked(spark, tmp_path):
    put(tmp_path / "e/1.json", json.dumps([{"qid": "1", "query": "a b", "terms": ["b"], "original": "a"}], indent=1))
    got = readers.expansions(spark, str(tmp_path / "e")).first()
    assert (got["query"], got["terms"]) == ("a b", ["b"])
    put(tmp_path / "r.csv", "qid,docid,rerank_score,rerank_rank\n1,doc2,0.5,1\n")
    assert rows(readers.reranked(spark, str(tmp_path / "r.csv")), "qid", "docid", "score") == [("1", "doc2", 0.5)]


def test_gpu_log(spark, tmp_path):
    def event(stamp, processes):
        return json.dumps({"nvidia_smi_log": {"timestamp": stamp, "gpu": {"product_name": "V100", "utilization": {"gpu_util": "5 %"}, "processes": {"process_info": processes}}}})

    p = {"pid": "9", "process_name": "python", "used_memory": "10 MiB", "type": "C"}
    put(tmp_path / "log.ndjson", "\n".join([event("Thu Feb 13 02:28:51 2025", [p]), event("Thu Feb  6 02:28:51 2025", None)]))
    log = readers.gpu_log(spark, str(tmp_path))
    flat = clean.explode_records(log.select("timestamp", "process_info"), "process_info", ["type", "gpu_instance_id", "compute_instance_id"])
    got = sorted(((r["timestamp"], r["pid"], r["used_memory"]) for r in flat.collect()), key=str)
    assert got == [(1738808931, None, None), (1739413731, "9", "10 MiB")]


def test_dev_sample(spark, tmp_path):
    many = [{"id": f"doc{i}", "contents": str(i)} for i in range(30)]
    put(tmp_path / "Json/2022-06_fr/a.json", json.dumps(many))
    put(tmp_path / "Json/2022-06_fr/b.json", json.dumps(many[:3]))
    put(tmp_path / "Trec/2022-06_fr/t.json", json.dumps(many))
    put(tmp_path / "Json/2022-06_fr/urls.json", json.dumps(many))
    got = readers.dev_sample(spark, str(tmp_path), 10)
    assert got.count() == 13
    assert [r["docid"] for r in got.where("file like '%a.json'").orderBy("pos").collect()] == [f"doc{i}" for i in range(10)]


def test_path_metadata_and_exists(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "train/French/2022-06"))
    tagged = readers.path_metadata(spark.read.parquet(str(tmp_path / "train/French/2022-06")))
    assert rows(tagged.distinct(), "split", "language", "date")[0] == ("train", "French", "2022-06")
    assert readers.exists(spark, str(tmp_path)) and not readers.exists(spark, str(tmp_path / "none"))


def test_run_files_are_gzipped_and_ordered(spark, tmp_path):
    data = [("m1", f"q{i % 3}", "Q0", f"doc{i}", i // 3 + 1, 1.0 / (i + 1), "tag") for i in range(9)]
    df = spark.createDataFrame(data, "date string, qid string, Q0 string, docno string, rank int, score double, tag string")
    sinks.write_run(df, str(tmp_path / "run"))
    files = sorted((tmp_path / "run/date=m1").glob("*.gz"))
    lines = [line for f in files for line in gzip.open(f, "rt").read().splitlines()]
    keys = [(line.split("\t")[0], int(line.split("\t")[3])) for line in lines]
    assert keys == sorted(keys) and len(lines) == 9 and lines[0].count("\t") == 5
    with pytest.raises(ValueError):
        sinks.write_run(df.limit(0), str(tmp_path / "empty"), require_rows=True)


def test_file_count_and_summary(spark, tmp_path):
    sinks.write_files(spark.range(100), str(tmp_path / "f"), 3)
    assert len(list((tmp_path / "f").glob("*.parquet"))) == 3
    sinks.write_summary(spark.range(1).toDF("a"), str(tmp_path / "s"))
    assert spark.read.csv(str(tmp_path / "s"), header=True).columns == ["a"]


def test_stream_picks_up_new_files_only(spark, tmp_path):
    source, target, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))

    def deliver():
        ingest_trec(spark, source, target, progress).awaitTermination()
        return rows(spark.read.parquet(target), "date", "docid", "split")

    put(tmp_path / "in/2022-06_fr/a.trec", doc("doc1", "x") + doc("doc1", "y"))
    assert deliver() == [("2022-06", "doc1", "train")]
    put(tmp_path / "in/2023-03_fr/a.trec", doc("doc1", "x"))
    put(tmp_path / "in/2022-06_fr/late.trec", doc("doc2", "late") + doc("doc1", "y"))
    want = [("2022-06", "doc1", "train"), ("2022-06", "doc2", "train"), ("2023-03", "doc1", "test")]
    assert deliver() == want
    assert deliver() == want
