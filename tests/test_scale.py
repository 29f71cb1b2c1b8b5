"""Plans and hot keys: what must hold when the data grows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strata import session
from strata.operators import clean, ranking, retrieval, stats
from strata.functions import text as X

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def tree_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def hot_rows(n=3000):
    """One key holds a third of all rows."""
    rng = random.Random(1)
    return [("hot" if i % 3 == 0 else f"k{rng.randint(0, 500)}", i) for i in range(n)]


@pytest.mark.parametrize("parts", [1000, 10, 1])
def test_lookup_join_equals_plain_join(spark, monkeypatch, parts):
    monkeypatch.setattr(session, "HOT_PARTS", parts)
    data = hot_rows()
    facts = spark.createDataFrame(data, "k string, v int")
    counts = Counter(k for k, _ in data)
    dim = spark.createDataFrame([(k, n, k.upper()) for k, n in counts.items() if k != "k7"], "k string, w bigint, name string")
    got = session.lookup_join(facts, dim, ["k"], "w")
    want = facts.join(dim, "k").select(got.columns)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()
    kept = session.lookup_join(facts, dim, ["k"], "w", how="left")
    assert kept.count() == facts.count() and kept.where("name is null").count() == counts["k7"]


@pytest.mark.parametrize("parts", [1000, 5])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_equals_plain_join(spark, monkeypatch, parts, how):
    monkeypatch.setattr(session, "HOT_PARTS", parts)
    data = hot_rows()
    facts = spark.createDataFrame(data, "k string, v int")
    names = {k for k, _ in data} - {"k7"}
    dim = spark.createDataFrame([(k, k.upper()) for k in names], "k string, name string")
    got = session.spread_join(facts, dim, ["k"], how, salts=8)
    want = facts.join(dim, ["k"], how).select(got.columns)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()
    sizes = session.spread_join(facts, dim, ["k"], how, salts=8).where("k = 'hot'").count()
    assert sizes == 1000


def test_running_sums_of_a_hot_group(spark):
    data = [("hot", p, float(p % 7)) for p in range(1, 3001)] + [("g", p, 1.0) for p in range(1, 5)]
    df = spark.createDataFrame(data, "g string, pos bigint, x double")
    got = {(r["g"], r["pos"]): r["s"] for r in ranking.running_sums(df, ["g"], "pos", {"s": F.col("x")}, 64).collect()}
    total = {"hot": 0.0, "g": 0.0}
    for g, p, x in data:
        total[g] += x
        assert got[g, p] == pytest.approx(total[g])


def test_judgements_of_one_query_in_many_blocks(spark):
    """A query with thousands of judgements, evaluated with all of them as ideal."""
    from strata.operators import evaluate

    qrels = spark.createDataFrame([("q", f"d{i:05}", 1 + i % 2) for i in range(5000)] + [("r", "d1", 1)], "qid string, docid string, rel int")
    run = spark.createDataFrame([("a", "q", f"d{i:05}", float(-i)) for i in range(20)] + [("a", "r", "d1", 1.0), ("b", "q", "d00001", 1.0)], "arm string, qid string, docid string, score double")
    got = {(r["arm"], r["qid"]): r for r in evaluate.evaluate(run, qrels, ["arm", "qid"], ["qid", "docid"], "judged").collect()}
    import math

    gains = [1 + i % 2 for i in range(20)]
    ideal = sorted((1 + i % 2 for i in range(5000)), reverse=True)
    dcg = sum(g / math.log2(i + 2) for i, g in enumerate(gains))
    idcg = sum(g / math.log2(i + 2) for i, g in enumerate(ideal))
    assert got["a", "q"]["ndcg"] == pytest.approx(dcg / idcg, abs=1e-6)
    assert got["a", "q"]["map"] == pytest.approx(20 / 5000, abs=1e-6)
    assert got["b", "q"]["ndcg_cut_10"] == pytest.approx(2 / sum(2 / math.log2(i + 2) for i in range(10)), abs=1e-6)
    assert got["a", "r"]["ndcg"] == 1.0
    at = up = 0.0
    rel = 0.0
    for i, g in enumerate(ideal):
        at += g / math.log2(i + 2)
        up += gains[i] / math.log2(i + 2) if i < 20 else 0
        rel += up / at
    assert got["a", "q"]["ndcg_rel"] == pytest.approx(rel / 5000, abs=1e-6)


def test_positions_of_a_hot_group(spark):
    rng = random.Random(2)
    data = [("hot" if i % 3 else f"g{i % 7}", rng.randint(0, 99), i) for i in range(2000)]
    df = spark.createDataFrame(data, "g string, x int, i int")
    got = ranking.positions(df, ["g"], F.floor(F.col("x") / 10), [F.asc("x"), F.asc("i")])
    seen = {(r["g"], r["x"], r["i"]): r["pos"] for r in got.collect()}
    for g in {r[0] for r in data}:
        for at, row in enumerate(sorted((r for r in data if r[0] == g), key=lambda r: (r[1], r[2])), 1):
            assert seen[row] == at


def test_dedup_of_a_hot_key(spark):
    data = [("m", k, f"{'x' * 60}{v}") for k, v in hot_rows()]
    df = spark.createDataFrame(data, "date string, docid string, contents string")
    got = {r["docid"]: r["contents"] for r in clean.keep_longest(df, ["date", "docid"]).collect()}
    longest = {}
    for _, k, t in data:
        longest[k] = max(longest.get(k, 0), len(t))
    assert {k: len(t) for k, t in got.items()} == longest


def test_dedup_reduces_before_the_shuffle(spark):
    df = spark.createDataFrame([("m", "d", "t")], "date string, docid string, contents string")
    plan = tree_of(clean.keep_smallest_hash(df, ["date", "docid"]))
    assert "partial_min_by" in plan and "Window" not in plan


def test_quantiles_count_equal_lengths_first(spark):
    counts = spark.createDataFrame([("m", 1)], "date string, chars bigint")
    plan = tree_of(stats.exact_length_quantiles(counts, ["date"], "chars"))
    assert "partial_count" in plan


def test_medians_equal_a_sort(spark):
    rng = random.Random(12)
    data = [(g, float(v)) for g in "abc" for v in ([rng.gauss(5, 2) for _ in range(rng.randrange(1, 400))] + [7.0] * 50)]
    data += [("one", 3.0), ("two", 1.0), ("two", 2.0), ("none", None)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {r["g"]: r["m"] for r in stats.medians(df, ["g"], "v", "m", width=16).collect()}
    for g in {g for g, v in data if v is not None}:
        values = sorted(v for k, v in data if k == g)
        n = len(values)
        assert got[g] == (values[(n - 1) // 2] + values[n // 2]) / 2
    assert "none" not in got


def test_slice_filter_prunes_partitions(spark, tmp_path):
    from strata.sources import sinks

    df = spark.createDataFrame([("a", "b", "2022-06", 1), ("a", "b", "2022-07", 2)], "split string, language string, date string, v int")
    sinks.write_slices(df, str(tmp_path / "s"))
    plan = plan_of(clean.slice_filter(spark.read.parquet(str(tmp_path / "s")), "2022-07"))
    assert "PartitionFilters: [isnotnull(date" in plan


def test_scan_reads_needed_columns_only(spark):
    from strata.plans import tables as T

    plan = plan_of(stats.rows_per(T.documents(spark, SF), ["date"]))
    assert "ReadSchema: struct<source:string>" in plan


def test_search_completes_scores_without_a_shuffle(spark, tmp_path):
    docs = spark.createDataFrame([("m", f"d{i}", "red apple pie") for i in range(50)], "date string, docid string, contents string")
    index = retrieval.write_index(docs, str(tmp_path / "ix"), X.simple_tokens)
    queries = spark.createDataFrame([("q", "red pie")], "qid string, query string")
    scored = tree_of(retrieval.score_matches(index, queries, ["date", "qid"], X.simple_tokens))
    head = scored[: scored.index("FileScan")]
    assert "BroadcastHashJoin" in scored and "Exchange hashpartitioning" not in head
    ranked = tree_of(retrieval.search(index, queries, ["date", "qid"], 5, analyzer=X.simple_tokens))
    assert ranked.count("WindowGroupLimit") == 2  # cut to k before and after the shuffle


def test_stored_index_keeps_slices_and_buckets(spark, tmp_path):
    rows = [(m, f"d{i}", "red apple pie") for m in ("2022-06", "2022-07") for i in range(40)]
    docs = spark.createDataFrame(rows, "date string, docid string, contents string")
    made = retrieval.write_index(docs, str(tmp_path / "ix"), X.simple_tokens, buckets=16)
    back = retrieval.read_index(spark, str(tmp_path / "ix"))
    queries = spark.createDataFrame([("q", "red pie")], "qid string, query string")
    options = dict(k=5, analyzer=X.simple_tokens)
    found = retrieval.search(back, queries, ["date", "qid"], **options)
    assert found.exceptAll(retrieval.search(made, queries, ["date", "qid"], **options)).isEmpty() and found.count() == 10
    scored = tree_of(retrieval.score_matches(back, queries, ["date", "qid"], X.simple_tokens))
    assert "Exchange hashpartitioning" not in scored[: scored.index("FileScan")]
    one = retrieval.search(back.only(["2022-07"]), queries, ["date", "qid"], **options)
    assert {r["date"] for r in one.collect()} == {"2022-07"}
    assert "PartitionFilters: [date" in plan_of(back.only(["2022-07"]).postings) or "PartitionFilters: [isnotnull(date" in plan_of(
        back.only(["2022-07"]).postings
    )


def test_bucket_count_follows_the_texts(spark):
    docs = spark.createDataFrame([("m", "d", "x" * 1000)] * 10, "date string, docid string, contents string")
    assert retrieval.bucket_count(docs) == retrieval.LEAST_BUCKETS
    assert retrieval.bucket_count(docs, bucket_bytes=100) == 128
    assert retrieval.bucket_count(docs.limit(0)) == retrieval.LEAST_BUCKETS


def test_a_cluster_must_name_a_shared_folder():
    session.require_one_machine("local[8]")
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError):
            session.require_one_machine(master)


def test_tokenizer_runs_once(spark):
    """No inferred filter may repeat the tokenizer below the projection."""
    from strata.operators import phrases
    from strata.plans import text_queries as Q

    plan = tree_of(phrases.unigram_counts(Q.tokens(spark, SF)))
    assert plan.count("regexp_extract_all") == 1


def test_large_query_sets_are_not_broadcast(spark):
    docs = spark.createDataFrame([("m", f"d{i}", "red apple pie") for i in range(50)], "date string, docid string, contents string")
    queries = spark.createDataFrame([(f"q{i}", "red pie") for i in range(20)], "qid string, query string")
    index = retrieval.index_of(docs, X.simple_tokens)
    salted = retrieval.score_matches(index, queries, ["date", "qid"], X.simple_tokens, max_broadcast=5)
    assert "__salt" in plan_of(salted)
    small = retrieval.score_matches(index, queries, ["date", "qid"], X.simple_tokens)
    assert small.exceptAll(salted).isEmpty() and small.count() == salted.count()


def test_candidates_drop_unfound_texts_before_the_shuffle(spark):
    docs = spark.range(3000).select(F.lit("m").alias("date"), F.concat(F.lit("d"), "id").alias("docid"), F.lit("text").alias("contents"))
    run = docs.where("docid < 'd11'").select("date", "docid", F.lit("q").alias("qid"), F.lit(1.0).alias("score"))
    kept = session.likely_in(docs, ["date", "docid"], run)
    wanted = {r["docid"] for r in run.collect()}
    got = {r["docid"] for r in kept.collect()}
    assert wanted <= got and len(got) < 1.2 * len(wanted) and kept.columns == docs.columns
    queries = spark.createDataFrame([("m", "q", "text")], "date string, qid string, query string")
    assert retrieval.candidates(run, docs, queries).count() == len(wanted)


def test_size_check(spark):
    assert session.fits(spark.range(10), 10) and not session.fits(spark.range(11), 10)


def test_written_tables_lie_in_the_shared_folder(spark):
    df = session.written(spark.range(3), "probe")
    assert session.shared_dir(spark) in df.inputFiles()[0]


def test_samples_do_not_depend_on_layout(spark):
    df = spark.range(2000).withColumn("key", F.col("id").cast("string"))
    a = clean.hash_sample(df.repartition(2), ["key"], 0.3)
    b = clean.hash_sample(df.repartition(7), ["key"], 0.3)
    assert a.exceptAll(b).isEmpty() and 500 < a.count() < 700
    train, held = clean.holdout_split(df, ["key"], 0.25)
    assert train.count() + held.count() == 2000 and train.intersect(held).isEmpty()
    assert clean.draw_queries(df, 17, 3, "key").count() == 17
    assert clean.draw_queries(df, 0, 3, "key").count() == 2000
    one = clean.shard(df, "key", 8, 3)
    assert one.select("sample_id").distinct().count() == 1


def test_spark_sampler_is_offered(spark):
    assert 0 < clean.bernoulli_sample(spark.range(1000), 0.5).count() < 1000


def test_quantiles_are_exact(spark):
    rng = random.Random(3)
    for values in ([1.0], [2.0, 1.0], [5.0] * 7, [1.0, 2.0, 3.0, 4.0], [round(rng.gauss(0, 1), 2) for _ in range(501)], [1e9, *range(99)]):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        got = {r.share: r.value for r in stats.quantiles(df, "v", [0.25, 0.5, 0.75], width=16).collect()}
        order = sorted(float(v) for v in values)
        assert got == {q: order[-int(-len(order) * q // 1) - 1] for q in (0.25, 0.5, 0.75)}
    assert {r.value for r in stats.quantiles(df.limit(0), "v", [0.25, 0.5]).collect()} == {None}
