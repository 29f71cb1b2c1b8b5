"""Jobs of the command line, end to end on a small collection."""

import random

import pytest
from pyspark.sql import functions as F

from strata import cli
from strata.sources import sinks

WORDS = {"a": ["chat", "chien", "souris", "jardin"], "b": ["soleil", "lune", "étoile", "ciel"]}


@pytest.fixture(scope="module")
def roots(spark, tmp_path_factory):
    rng = random.Random(4)
    base = tmp_path_factory.mktemp("collection")
    for split, months in (("train", ["2022-06", "2022-07"]), ("test", ["2023-03"])):
        docs, queries, qrels = [], [], []
        for month in months:
            for i in range(24):
                kind = "a" if i % 2 else "b"
                text = " ".join(rng.choice(WORDS[kind]) for _ in range(30)) + " grand fleuve"
                text += " petit port" if kind == "a" else ""
                docs.append((f"doc{i}", text, split, "French", month))
            docs.append(("doc0", "trop court", split, "French", month))
            for q, kind in (("1", "a"), ("2", "b")):
                queries.append((q, " ".join(WORDS[kind][:2]), split, "French", month))
                qrels += [(q, 0, str(i), 2, split, "French", month) for i in range(24) if (i % 2 == 1) == (kind == "a")]
        tail = ", split string, language string, date string"
        sinks.write_slices(spark.createDataFrame(docs, "docid string, contents string" + tail), f"{base}/{split}/Documents")
        sinks.write_slices(spark.createDataFrame(queries, "qid string, query string" + tail), f"{base}/{split}/Queries")
        sinks.write_slices(spark.createDataFrame(qrels, "qid string, rank int, docid string, rel int" + tail), f"{base}/{split}/Qrels")
    return base


def call(spark, *argv):
    cli.run(spark, cli.parser().parse_args([str(a) for a in argv]))


def test_topic_jobs(spark, roots, tmp_path):
    prepared, trained, held = tmp_path / "prep", tmp_path / "lda", tmp_path / "held"
    call(spark, "lda-preprocess", roots / "train", prepared, "--min-count", 3, "--threshold", 0.3, "--min-df", 2, "--max-df", 0.9)
    found = spark.read.parquet(str(prepared / "phrases"))
    assert found.where("a = 'petit' and b = 'port'").count() == 1
    # Perfect and by far the most frequent: screened as a list.
    assert found.where("a = 'grand'").isEmpty()
    call(spark, "lda-sweep", prepared, trained, "--ks", "2,3", "--max-iter", 4)
    call(spark, "lda-sweep", prepared, trained, "--ks", "2,3,4", "--max-iter", 4)  # only 4 is fitted
    sweep = spark.read.parquet(str(trained / "sweep"))
    assert sorted(r["k"] for r in sweep.collect()) == [2, 3, 4]
    sums = spark.read.parquet(str(trained / "proportions")).groupBy("k", "date").agg(F.sum("mean_theta").alias("s"))
    assert sums.where("abs(s - 1) > 1e-6").isEmpty() and sums.count() == 6
    call(spark, "lda-heldout-drift", prepared, trained, roots / "test", held, "--ks", "2")
    moved = spark.read.parquet(str(held / "drift"))
    assert {r["n_slices"] for r in moved.collect()} == {3}
    call(spark, "lda-topic-proportions", trained, tmp_path / "again", "--ks", "2")
    assert spark.read.parquet(str(tmp_path / "again/drift")).count() == 2
    call(spark, "lda-conv-probe", prepared, tmp_path / "probe", "--k", 2, "--iterations", "1,2", "--offsets", "16")
    assert spark.read.csv(str(tmp_path / "probe"), header=True).count() == 2
    call(spark, "lda-query-topics", prepared, trained, roots / "train", tmp_path, "--k", 2)
    assert spark.read.parquet(str(tmp_path / "query_topics_k2")).count() == 2


def test_a_stopped_sweep_goes_on(spark, roots, tmp_path, monkeypatch):
    from strata.plans import jobs

    prepared, trained = str(tmp_path / "prep"), str(tmp_path / "lda")
    call(spark, "lda-preprocess", roots / "train", prepared, "--min-count", 3, "--threshold", 0.3, "--min-df", 2, "--max-df", 0.9)
    saved, save, infer = [], jobs._save_size, jobs.theta

    def stopping(session, model, k, out, params):
        if saved:
            raise KeyboardInterrupt
        save(session, model, k, out, params)
        saved.append(k)

    options = dict(ks=[2, 3], max_iter=2)
    monkeypatch.setattr(jobs, "_save_size", stopping)
    with pytest.raises(KeyboardInterrupt):  # after the first model
        jobs.lda_sweep(spark, prepared, trained, **options)
    assert jobs.fitted_sizes(spark, trained, [2, 3], {"max_iter": 2}) == set(saved)

    def counting(session, model, k, out, params):
        save(session, model, k, out, params)
        saved.append(k)

    def failing(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(jobs, "_save_size", counting)
    monkeypatch.setattr(jobs, "theta", failing)
    with pytest.raises(KeyboardInterrupt):  # after the last model
        jobs.lda_sweep(spark, prepared, trained, **options)
    assert sorted(saved) == [2, 3]
    monkeypatch.setattr(jobs, "theta", infer)
    jobs.lda_sweep(spark, prepared, trained, **options)
    assert sorted(saved) == [2, 3] and spark.read.parquet(f"{trained}/sweep").count() == 2
    jobs.lda_sweep(spark, prepared, trained, ks=[2], max_iter=3)  # other parameters: fitted anew
    assert sorted(saved) == [2, 2, 3]


def test_retrieval_job(spark, roots, tmp_path):
    (tmp_path / "exp").mkdir()
    (tmp_path / "exp/1.json").write_text('[{"qid": "1", "query": "chat chien souris", "terms": ["souris"], "original": "chat chien"}]')
    both = f"{roots}/train,{roots}/test"
    call(spark, "bm25", both, tmp_path / "out", "--k", 5, "--expansions", tmp_path / "exp")
    run = spark.read.parquet(str(tmp_path / "out/retrieval"))
    assert run.groupBy("arm", "date", "qid").count().where("count <> 5").isEmpty()
    scores = spark.read.parquet(str(tmp_path / "out/scores"))
    assert scores.count() == 2 * 3 * 2 and scores.where("ndcg_cut_10 < 1").isEmpty()
    assert (tmp_path / "out/submission/original/date=2022-06").exists()
    judged = run.select(F.lit("x").alias("experiment"), "date", "qid", "docid", "score")
    judged.where("arm = 'original'").write.parquet(str(tmp_path / "run"))
    call(spark, "evaluate", tmp_path / "run", roots / "train/Qrels", tmp_path / "ev")
    assert spark.read.csv(str(tmp_path / "ev/summary"), header=True).count() == 1


def test_rerank_job(spark, roots, tmp_path):
    call(spark, "bm25", roots / "train", tmp_path / "ix", "--k", 5)
    run = tmp_path / "ix/retrieval/arm=original"
    call(spark, "rerank", roots / "train", run, tmp_path / "rr", "--seeds", "1,2", "--queries", 1)
    results = spark.read.parquet(str(tmp_path / "rr/results"))
    assert {(r["arm"], r["seed"]) for r in results.collect()} == {(a, s) for a in ("bm25", "rerank") for s in (1, 2)}
    assert results.where("arm = 'rerank' and pairs_per_s > 0").count() == results.where("arm = 'rerank'").count() > 0
    assert spark.read.csv(str(tmp_path / "rr/throughput"), header=True).count() == 1
    assert spark.read.csv(str(tmp_path / "rr/by_seed"), header=True).where("n_seeds = 2").count() > 0


def test_corpus_jobs(spark, roots, tmp_path):
    call(spark, "diagnostics", f"{roots}/train,{roots}/test", tmp_path / "d")
    pooled = spark.read.csv(str(tmp_path / "d/pooled"), header=True).first()
    assert pooled["n_docs"] == "75" and spark.read.csv(str(tmp_path / "d/by_date"), header=True).count() == 3
    call(spark, "tokens", f"{roots}/train,{roots}/test", tmp_path / "t")
    assert spark.read.csv(str(tmp_path / "t/summary"), header=True).count() == 2
    call(spark, "embedding", roots / "train", tmp_path / "e", "--shards", 3, "--dims", 8)
    rows = spark.read.parquet(str(tmp_path / "e/data"))
    assert rows.count() == 24 and set(rows.columns) >= {"docid", "contents", "embedding", "sample_id"}
    call(spark, "nmf", roots / "train", tmp_path / "n", "--k", 2, "--sample", 0.8)
    assert spark.read.parquet(str(tmp_path / "n/topic_words")).where("topic = 0").count() > 3


def test_raw_jobs(spark, tmp_path):
    import json

    folder = tmp_path / "raw/rel/French/base/Json/2022-06_fr"
    folder.mkdir(parents=True)
    (folder / "a.json").write_text(json.dumps([{"id": f"doc{i}", "contents": "x"} for i in range(12)]))
    for kind, line in (("queries", "1\task\n"), ("qrels", "1 0 1 1\n")):
        other = tmp_path / f"raw/rel/French/base/{kind}"
        other.mkdir()
        (other / f"2022-06_{kind}.txt").write_text(line)
    call(spark, "dev-sample", tmp_path / "raw", tmp_path / "dev", "--limit", 5)
    assert spark.read.json(str(tmp_path / "dev")).count() == 5
    call(spark, "parquet", tmp_path / "raw", tmp_path / "pq")
    assert spark.read.parquet(str(tmp_path / "pq/Documents")).count() == 12
    trec = tmp_path / "trec/Trec/2022-06_fr"
    trec.mkdir(parents=True)
    (trec / "a.trec").write_text("<DOC><DOCNO>doc1</DOCNO><TEXT>t</TEXT></DOC>")
    for kind in ("queries", "qrels/2022-06_fr"):
        (tmp_path / "trec" / kind).mkdir(parents=True)
    (tmp_path / "trec/queries/2022-06_queries.txt").write_text("1\task\n")
    (tmp_path / "trec/qrels/2022-06_fr/qrels_processed.txt").write_text("1 0 1 1\n")
    call(spark, "trec-parquet", tmp_path / "trec", tmp_path / "tp", "--dates", "2022-06")
    assert spark.read.parquet(str(tmp_path / "tp/Qrels")).count() == 1
