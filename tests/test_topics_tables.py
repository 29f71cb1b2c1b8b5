"""Coherence, proportions and drift on hand-computed inputs.

Inputs and results marked as golden are fixed values that any implementation
must reproduce; the tests against plain Python counts have inputs of their own.
"""

import math

import pytest
from pyspark.sql import functions as F

from strata.functions import vectors as V
from strata.operators import coherence, drift, stats


def words(spark, topics):
    rows = [(4, t, i, w) for t, ws in enumerate(topics) for i, w in enumerate(ws)]
    return spark.createDataFrame(rows, "k int, topic int, pos int, word string")


def docs(spark, bags):
    return spark.createDataFrame([(b,) for b in bags], "tokens_phrased array<string>")


def scores(spark, bags, topics, n=3):
    out = coherence.topic_npmi(docs(spark, bags), words(spark, topics), n=n).collect()
    return {r["topic"]: (r["npmi"], r["n_docs"]) for r in out}


def test_coherence_by_hand(spark):
    bags = [["a", "b", "c"], ["a", "b"], ["c", "d"], ["e"], []]
    got = scores(spark, bags, [["a", "b", "c"], ["c", "d", "e"]])
    assert got[0][0] == pytest.approx(0.426, abs=0.01)
    assert got[1][0] == pytest.approx(-0.408, abs=0.01)
    assert got[0][1] == 5
    table = coherence.coherence_table(
        docs(spark, bags), words(spark, [["a", "b", "c"], ["c", "d", "e"]]), n=3
    ).first()
    assert table["topic_diversity"] == pytest.approx(5 / 6, abs=1e-6)
    assert table["mean_npmi"] == pytest.approx((got[0][0] + got[1][0]) / 2, abs=1e-6)
    assert table["top_words"] == [["a", "b", "c"], ["c", "d", "e"]]


def test_denominator_is_all_documents(spark):
    bags = [["a", "b"], ["a"], ["b"]]
    assert scores(spark, bags, [["a", "b"]])[0][0] == pytest.approx(-0.262, abs=0.01)
    more = bags + [["z1"], ["z2"], ["z3"]]
    assert scores(spark, more, [["a", "b"]])[0][0] == pytest.approx(0.226, abs=0.01)


def test_empty_documents_score_zero(spark):
    assert scores(spark, [[], [], []], [["a", "b"]]) == {0: (0.0, 3)}


def test_npmi_edges(spark):
    assert scores(spark, [["a"], ["b"]], [["a"]])[0][0] == 0.0
    together = [["a", "b"]] + [["x"]] * 9
    assert scores(spark, together, [["a", "b"]])[0][0] == pytest.approx(1.0, abs=1e-6)
    apart = [["a"], ["b"]] + [["x"]] * 8
    assert -1 < scores(spark, apart, [["a", "b"]])[0][0] < -0.5
    assert scores(spark, [["a"], ["x"]], [["a", "b"]])[0][0] == 0.0


def test_diversity(spark):
    def of(*topics):
        return coherence.diversity(words(spark, topics), ["k"], 10).first()["topic_diversity"]

    assert of(["a", "b"], ["c", "d"]) == 1.0
    assert of(["a", "b"], ["a", "b"]) == 0.5
    assert coherence.diversity(words(spark, []), ["k"], 10).count() == 0


DOC_TOPICS = [("d0", [0.9, 0.1]), ("d1", [0.2, 0.8]), ("d2", [0.5, 0.5]), ("d3", [0.3, 0.7])]
CORPUS = [("d0", "2022-06"), ("d1", "2022-06"), ("d2", "2022-06"), ("d0", "2022-07"), ("d1", "2022-07"), ("d3", "2022-07")]


@pytest.fixture
def proportions(spark):
    theta = spark.createDataFrame(DOC_TOPICS, "docid string, theta array<double>")
    corpus = spark.createDataFrame(CORPUS, "docid string, date string")
    return drift.slice_proportions_by_docid(corpus, theta, 2)


def test_proportions_by_hand(proportions):
    got = {(r["date"], r["topic"]): r for r in proportions.collect()}
    assert len(got) == 4 and {r["n_docs"] for r in got.values()} == {3}
    assert got["2022-06", 0]["mean_theta"] == pytest.approx(1.6 / 3, abs=1e-9)
    assert got["2022-07", 0]["mean_theta"] == pytest.approx(1.4 / 3, abs=1e-9)
    for date in ("2022-06", "2022-07"):
        assert got[date, 0]["mean_theta"] + got[date, 1]["mean_theta"] == pytest.approx(1.0)


def test_drift_by_hand(proportions):
    row = drift.drift(proportions).where(F.col("topic") == 0).first()
    assert row["n_slices"] == 2
    assert row["range_theta"] == pytest.approx(0.2 / 3, abs=1e-9)
    assert row["delta_first_last"] == pytest.approx(-0.2 / 3, abs=1e-9)


def test_heldout_extension(spark):
    train = spark.createDataFrame(
        [(2, "2022-06", 0, 0.6, 10), (2, "2022-06", 1, 0.4, 10), (2, "2022-07", 0, 0.5, 10), (2, "2022-07", 1, 0.5, 10)],
        "k int, date string, topic int, mean_theta double, n_docs bigint",
    )
    theta = spark.createDataFrame(
        [("2023-03", [0.8, 0.2]), ("2023-03", [0.1, 0.9]), ("2023-03", [0.4, 0.6]), ("2023-04", [0.7, 0.3])],
        "date string, theta array<double>",
    )
    held = drift.slice_proportions(theta, 2)
    every = drift.extend(train, held.withColumn("n_docs", F.col("n_docs").cast("int")))
    assert every.schema == train.schema and every.count() == 8
    assert every.where("date < '2023'").exceptAll(train).isEmpty()
    cells = {(r["date"], r["topic"]): r for r in held.collect()}
    assert cells["2023-03", 0]["mean_theta"] == pytest.approx(1.3 / 3) and cells["2023-03", 0]["n_docs"] == 3
    assert cells["2023-04", 0]["mean_theta"] == pytest.approx(0.7) and cells["2023-04", 0]["n_docs"] == 1
    row = drift.drift(every).where("topic = 0").first()
    assert row["n_slices"] == 4
    assert row["first_theta"] == pytest.approx(0.6) and row["last_theta"] == pytest.approx(0.7)
    assert row["delta_first_last"] == pytest.approx(0.1)
    assert row["range_theta"] == pytest.approx(0.7 - 1.3 / 3)


def test_copies_do_not_mix_slices(spark):
    """The same docid in two slices keeps its own vector per slice."""
    theta = spark.createDataFrame(
        [("d", "2022-06", [1.0, 0.0]), ("d", "2022-07", [0.0, 1.0])], "docid string, date string, theta array<double>"
    )
    got = {(r["date"], r["topic"]): r["mean_theta"] for r in drift.slice_proportions(theta, 2).collect()}
    assert got == {("2022-06", 0): 1.0, ("2022-06", 1): 0.0, ("2022-07", 0): 0.0, ("2022-07", 1): 1.0}
    spread = stats.copy_divergence(theta, 2).first()
    assert spread["n_dup"] == 1 and spread["worst_max_sd"] == pytest.approx(math.sqrt(0.5), abs=1e-6)


def test_vector_functions(spark):
    row = spark.createDataFrame([([3.0, 1.0], [1.0, 3.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>").select(
        V.cosine(F.col("a"), F.col("b")).alias("cos"),
        V.cosine(F.col("a"), F.col("z")).alias("zero"),
        V.hellinger_similarity(F.col("a"), F.col("b")).alias("hell"),
        V.normalised(F.col("a")).alias("n"),
        V.normalised(F.col("z")).alias("nz"),
        V.dominant(F.array(F.lit(0.4), F.lit(0.4)), F.lit(1.0)).alias("first"),
        V.dominant(F.array(F.lit(0.0), F.lit(0.0)), F.lit(0.0)).alias("none"),
    ).first()
    assert row["cos"] == pytest.approx(0.6) and row["zero"] == 0.0
    want = 1 - math.sqrt((math.sqrt(0.75) - 0.5) ** 2 * 2) / math.sqrt(2)
    assert row["hell"] == pytest.approx(want)
    assert row["n"] == [0.75, 0.25] and row["nz"] == [0.0, 0.0]
    assert row["first"] == 0 and row["none"] is None


def test_coherence_equals_a_count_in_plain_python(spark):
    import itertools
    import random

    rng = random.Random(21)
    vocabulary = [f"w{i}" for i in range(12)]
    bags = [rng.choices(vocabulary, k=rng.randrange(1, 9)) for _ in range(80)]
    topics = [rng.sample(vocabulary, 4) for _ in range(3)]
    sets, n = [set(b) for b in bags], len(bags)

    def npmi(a, b):
        both = sum(a in s and b in s for s in sets) / n + coherence.EPSILON
        pa, pb = (sum(w in s for s in sets) / n for w in (a, b))
        return math.log(both / (pa * pb)) / -math.log(both)

    want = {t: sum(npmi(a, b) for a, b in itertools.combinations(ws, 2)) / 6 for t, ws in enumerate(topics)}
    got = coherence.topic_npmi(docs(spark, bags), words(spark, topics), ["k"], n=4).collect()
    assert {r["topic"]: round(r["npmi"], 9) for r in got} == {t: round(v, 9) for t, v in want.items()}
