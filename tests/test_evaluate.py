"""Metrics on hand-made cases and against brute force."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from strata.operators import evaluate

RUN = "qid string, docid string, score double"
QRELS = "qid string, docid string, rel int"


def evaluated(spark, run, qrels, **options):
    r = spark.createDataFrame(run, RUN)
    q = spark.createDataFrame(qrels, QRELS)
    return {x["qid"]: x for x in evaluate.evaluate(r, q, ["qid"], **options).collect()}


def dcg(grades):
    return sum(g / math.log2(i + 2) for i, g in enumerate(grades))


def test_metrics_by_hand(spark):
    run = [("q", "doc1", 3.0), ("q", "doc2", 2.0), ("q", "doc3", 1.0)]
    qrels = [("q", "2", 2), ("q", "3", 1), ("q", "9", 2)]
    got = evaluated(spark, run, qrels)["q"]
    assert got["ndcg"] == pytest.approx(dcg([0, 2, 1]) / dcg([2, 1]), abs=1e-6)
    assert got["map"] == pytest.approx((1 / 2 + 2 / 3) / 2, abs=1e-6)
    strict = evaluated(spark, run, qrels, ideal="judged")["q"]
    assert strict["ndcg"] == pytest.approx(dcg([0, 2, 1]) / dcg([2, 2, 1]), abs=1e-6)
    assert strict["map"] == pytest.approx((1 / 2 + 2 / 3) / 3, abs=1e-6)
    at = [dcg([0, 2, 1][:i]) / dcg([2, 1][:i]) for i in (1, 2)]
    assert got["ndcg_rel"] == pytest.approx(sum(at) / 2, abs=1e-6)


def test_cut_at_ten(spark):
    run = [("q", f"d{i:02}", 20.0 - i) for i in range(12)]
    got = evaluated(spark, run, [("q", "d11", 1), ("q", "d00", 1)])["q"]
    assert got["ndcg_cut_10"] == pytest.approx(dcg([1]) / dcg([1, 1]), abs=1e-6)


def test_ties_are_ordered_by_descending_docid(spark):
    run = [("q", "a", 1.0), ("q", "b", 1.0)]
    assert evaluated(spark, run, [("q", "b", 1)])["q"]["map"] == 1.0
    assert evaluated(spark, run, [("q", "a", 1)])["q"]["map"] == 0.5


def test_no_relevant_and_unjudged_queries(spark):
    run = [("q", "a", 1.0), ("r", "a", 1.0)]
    got = evaluated(spark, run, [("q", "z", 1)])
    assert got["q"]["ndcg"] == 0.0 and got["r"]["map"] == 0.0
    assert set(evaluated(spark, run, [("q", "z", 1)], ideal="judged")) == {"q"}


def test_queries_without_hits_can_count_as_zero(spark):
    run = spark.createDataFrame([("q", "a", 1.0)], RUN)
    qrels = spark.createDataFrame([("q", "a", 1)], QRELS)
    scores = evaluate.evaluate(run, qrels, ["qid"])
    asked = spark.createDataFrame([("q",), ("none",)], "qid string")
    got = {r["qid"]: r["map"] for r in evaluate.with_missing(scores, asked, ["qid"]).collect()}
    assert got == {"q": 1.0, "none": 0.0}


def test_binary_ndcg_cases(spark):
    run = spark.createDataFrame(
        [("one", "a", 1.0), ("miss", "b", 1.0), ("tie", "a", 1.0), ("tie", "b", 1.0), ("two", "a", 2.0), ("two", "b", 1.0)], RUN
    )
    qrels = spark.createDataFrame([("one", "a", 2), ("tie", "a", 1), ("two", "b", 1)], QRELS)
    got = {r["qid"]: (r["ndcg"], r["rel_count"]) for r in evaluate.binary_ndcg(run, qrels, ["qid"]).collect()}
    assert got["one"] == (1.0, 1) and got["miss"] == (0.0, 0)
    assert got["tie"][0] == pytest.approx(0.5 * (1 + 1 / math.log2(3)), abs=1e-6)
    assert got["two"][0] == pytest.approx(1 / math.log2(3), abs=1e-6)


def test_auc_against_all_pairs(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice([0, 0, 1, 2]), round(rng.choice([-1, 1]) * rng.random(), 2)) for _ in range(400)]
    df = spark.createDataFrame(rows, "qid string, rel int, score double")

    def brute(part):
        pos = [s for _, r, s in part if r > 0]
        neg = [s for _, r, s in part if r <= 0]
        wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
        return wins / (len(pos) * len(neg))

    assert evaluate.auc(df, []).first()["auc"] == pytest.approx(brute(rows), abs=1e-6)
    per = {r["qid"]: r["auc"] for r in evaluate.auc(df, ["qid"]).collect()}
    for q in "ab":
        assert per[q] == pytest.approx(brute([x for x in rows if x[0] == q]), abs=1e-6)
    macro = evaluate.macro_auc(df).first()
    assert macro["n_queries"] == 2 and macro["macro_auc"] == pytest.approx(sum(per.values()) / 2, abs=1e-6)


def test_auc_needs_both_classes(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 1, 0.2)], "qid string, rel int, score double")
    assert evaluate.auc(df, ["qid"]).isEmpty()


def test_kendall_against_all_pairs(spark):
    rng = random.Random(5)
    rows = []
    for q, n in (("a", 17), ("b", 33), ("c", 3), ("d", 2), ("e", 8)):
        for _ in range(n):
            rows.append((q, float(rng.randint(0, 6)), 1.0 if q == "e" else float(rng.randint(0, 6))))
    df = spark.createDataFrame(rows, "qid string, x double, y double")
    got = {r["qid"]: r["tau"] for r in evaluate.kendall_tau(df, ["qid"], "x", "y").collect()}
    want = {}
    for q in "abc":
        part = [(x, y) for k, x, y in rows if k == q]
        if len({x for x, _ in part}) < 2 or len({y for _, y in part}) < 2:
            continue
        sign = lambda v: (v > 0) - (v < 0)
        pairs = list(itertools.combinations(part, 2))
        top = sum(sign(a[0] - b[0]) * sign(a[1] - b[1]) for a, b in pairs)
        nx = sum(a[0] != b[0] for a, b in pairs)
        ny = sum(a[1] != b[1] for a, b in pairs)
        want[q] = pytest.approx(top / math.sqrt(nx * ny), abs=1e-6)
    assert got == want


def test_summaries(spark):
    rows = spark.createDataFrame(
        [("bm25", 0.5), ("worse", 0.25), ("again", 0.375)], "arm string, ndcg_cut_10 double"
    )
    out = evaluate.recovered(rows, "bm25", "worse", "again", "ndcg_cut_10").first()
    assert out["loss"] == 0.25 and out["recovered"] == 0.5
    sweep = spark.createDataFrame([(2, 0.1), (4, 0.3), (8, 0.3)], "k int, score double")
    assert evaluate.best_of(sweep, "score", "k").first()["k"] == 4


def test_run_summary_counts_candidates(spark):
    run = spark.createDataFrame([("m", "q", "a"), ("m", "q", "b"), ("m", "r", "a")], "date string, qid string, docid string")
    scores = spark.createDataFrame([("m", 0.5), ("m", 1.0)], "date string, ndcg_cut_10 double")
    row = evaluate.run_summary(scores, run, ["date"], wall_seconds=2.0).first()
    assert (row["n_pairs"], row["k_candidates"], row["pairs_per_s"]) == (3, 1, 1.5)
    assert row["ndcg10_mean"] == 0.75
    assert scores.where(F.col("ndcg_cut_10") > 1).isEmpty()
