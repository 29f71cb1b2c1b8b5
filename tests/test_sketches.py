"""Sketches of slices against exact answers, and other small operators."""

import pytest
from pyspark.sql import functions as F

from strata.operators import evaluate, sketches, stats


def test_store_answers_within_its_bounds(spark, tmp_path):
    n = 60_000
    rows = spark.range(n).select(
        F.concat(F.lit("m"), F.col("id") % 3).alias("date"),
        F.concat(F.lit("k"), F.floor(F.col("id") / 2)).alias("key"),
        F.pmod(F.col("id") * 7919, F.lit(10_007)).alias("length"),
    )
    path = str(tmp_path / "store")
    for half in (0, 1):
        sketches.add_slices(rows.where(F.col("length") % 2 == half), path, ["date"], F.col("key"), F.col("length"))
    store = sketches.read(spark, path)
    assert store.count() == 6
    whole = sketches.quantiles(sketches.merged(store, []), [], [0.1, 0.5, 0.9]).first()
    lengths = sorted(r.length for r in rows.select("length").collect())
    for q, got in ((0.1, whole.p10), (0.5, whole.p50), (0.9, whole.p90)):
        place = sum(v <= got for v in lengths) / n
        assert abs(place - q) < 0.04
    assert whole.n == n and abs(whole.n_distinct - n / 2) < 0.06 * n / 2
    pairs = {r.date: r for r in sketches.overlaps(sketches.merged(store, ["date"]), "date").collect()}
    keys = {}
    for r in rows.select("date", "key").distinct().collect():
        keys.setdefault(r.date, set()).add(r.key)
    for a, b in (("m0", "m1"), ("m1", "m2")):
        both, either = len(keys[a] & keys[b]), len(keys[a] | keys[b])
        assert abs(pairs[a].n_both - both) < 0.15 * either and abs(pairs[a].n_either - either) < 0.08 * either


def test_store_is_read_instead_of_the_corpus(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", 1), ("a", None, None), ("b", "x", 5), ("b", "y", 2)], "date string, key string, length int")
    corpus, path = str(tmp_path / "corpus"), str(tmp_path / "store")
    rows.write.parquet(corpus)
    sketches.add_slices(spark.read.parquet(corpus), path, ["date"], F.col("key"), F.col("length"))
    asked = sketches.quantiles(sketches.merged(sketches.read(spark, path), ["date"]), ["date"], [0.5])
    assert corpus not in asked._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in asked.collect()} == {("a", 2, 1, 1), ("b", 2, 2, 2)}
    pair = sketches.overlaps(sketches.merged(sketches.read(spark, path), ["date"]), "date").first()
    assert (pair.n_both, pair.n_either, pair.jaccard) == (1, 2, 0.5)


def test_maps_of_runs(spark):
    rows = [("m", "q", "a", 1.0, 2), ("m", "q", "b", 3.0, 0), ("m", "q", "b", 2.0, 0), ("m", "r", "a", 5.0, 1)]
    judged = spark.createDataFrame(rows, "date string, qid string, docid string, score double, rel int")
    got = {r.qid: (r.scores, r.rels) for r in evaluate.as_maps(judged, ["date", "qid"]).collect()}
    assert got == {"q": ({"a": 1.0, "b": 3.0}, {"a": 2, "b": 0}), "r": ({"a": 5.0}, {"a": 1})}
    assert evaluate.as_maps(judged.limit(0), ["date", "qid"]).count() == 0


def test_elapsed_minutes(spark):
    rows = spark.createDataFrame([("a", 60), ("a", 150), ("b", 7), ("b", None)], "g string, at long")
    got = {(r.g, r["at"]): r.minutes for r in stats.elapsed_minutes(rows, ["g"], "at").collect()}
    assert got == {("a", 60): 0.0, ("a", 150): pytest.approx(1.5), ("b", 7): 0.0, ("b", None): None}
