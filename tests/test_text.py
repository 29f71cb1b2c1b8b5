"""Tokenizers, analyzers and phrase mining."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strata.functions import text as X
from strata.operators import phrases

# Input strings with the tokens expected of the French analyzer.
FRENCH = [
    ("Le chat noir mange la souris.", ["chat", "noir", "mang", "souri"]),
    ("L'eau de la rivière coule aujourd'hui qu'est-ce", ["eau", "rivier", "coul", "aujourd'hui"]),
    ("MAJUSCULES et minuscules MÉLANGÉES", ["majuscul", "minuscul", "melang"]),
    ("ponctuation !!! ... ?? «citation» — tiret", ["ponctu", "cit", "tiret"]),
    ("changement climatique, développement durable", ["chang", "climat", "develop", "durabl"]),
    ("janvier histoire auteurs Marie guerre annulée", ["janvi", "histoir", "auteu", "mar", "guer", "anul"]),
    ("", []),
    ("   ", []),
    ("a", ["a"]),
    ("café\tthé\nlait   espaces   multiples", ["café", "thé", "lait", "espac", "multipl"]),
    ("123 456 7890 numérique pur 0042", ["123", "456", "7890", "nume", "pur", "0042"]),
    (None, []),
]


def test_french_analyzer(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(FRENCH)], "i int, t string")
    got = {r["i"]: r["k"] for r in rows.select("i", X.french_tokens("t").alias("k")).collect()}
    for i, (text, want) in enumerate(FRENCH):
        assert got[i] == want, text


def test_token_filter_and_counts(spark):
    row = spark.createDataFrame([("The cats 42 ab  x1y and l'été,",)], "t string").select(
        X.content_tokens(X.simple_tokens("t")).alias("content"),
        X.words_by_space("t").alias("by_space"),
        X.words_by_blank("t").alias("by_blank"),
        X.token_count("t").alias("tokens"),
        X.english_density("t").alias("density"),
    ).first()
    assert row["content"] == ["cats", "x1y"]
    assert (row["by_space"], row["by_blank"], row["tokens"]) == (8, 7, 8)
    assert row["density"] == pytest.approx(2 / 7)


def test_pairs_of_short_arrays(spark):
    rows = spark.createDataFrame([([],), (["a"],), (["a", "b", "a"],)], "t array<string>")
    got = [[(p["a"], p["b"]) for p in r["p"]] for r in rows.select(X.adjacent_pairs("t").alias("p")).collect()]
    assert got == [[], [], [("a", "b"), ("b", "a")]]


def test_encoder_hook(spark):
    count = X.encoder_token_count(lambda: (lambda text: text.split("-")))
    rows = spark.createDataFrame([("a-b-c",), (None,)], "t string")
    assert [r["n"] for r in rows.select(count("t").alias("n")).collect()] == [3, 1]


BAGS = [["new", "york", "city"]] * 4 + [["new", "car"], ["york", "pie"], ["big", "city"], [], ["alone"]]


def corpus(spark):
    return spark.createDataFrame([("m", f"d{i}", b) for i, b in enumerate(BAGS)], "date string, docid string, tokens array<string>")


def brute_npmi(bags, min_count, threshold):
    uni = Counter(w for b in bags for w in b)
    total = sum(uni.values())
    big = Counter(p for b in bags for p in zip(b, b[1:]))
    out = {}
    for (a, b), n in big.items():
        if n >= min_count and uni[a] >= min_count and uni[b] >= min_count:
            p = n / total
            value = math.log(p / (uni[a] / total * uni[b] / total)) / -math.log(p)
            if value >= threshold:
                out[a, b] = (pytest.approx(value), n)
    return out


@pytest.mark.parametrize("min_count,threshold", [(1, -1.0), (2, 0.3), (4, 0.5)])
def test_npmi_against_brute_force(spark, min_count, threshold):
    scored = phrases.score_pairs(corpus(spark), min_count=min_count, threshold=threshold)
    got = {(r["a"], r["b"]): (r["npmi"], r["count"]) for r in scored.collect()}
    assert got == brute_npmi(BAGS, min_count, threshold)


def scored_table(spark, rows):
    return spark.createDataFrame(rows, "a string, b string, npmi double, count bigint")


def test_list_screen(spark):
    rows = [("x", str(i), 0.97, i + 1) for i in range(9)] + [("list", "item", 0.99, 1000), ("many", "times", 0.5, 5000)]
    kept = {(r["a"], r["b"]) for r in phrases.screen_lists(scored_table(spark, rows), 0.95, 99.9).collect()}
    assert ("list", "item") not in kept and ("many", "times") in kept and len(kept) == 10
    assert phrases.screen_lists(scored_table(spark, rows), 1.1, 99.9).count() == 11


def test_list_screen_without_suspects(spark):
    rows = [("a", "b", 0.5, 10), ("c", "d", 0.6, 20)]
    assert phrases.screen_lists(scored_table(spark, rows)).count() == 2


def test_screen_cut_is_the_exact_discrete_percentile(spark):
    rows = [("x", str(i), 0.99, i) for i in range(1, 101)]
    scored = scored_table(spark, rows)
    want = scored.approxQuantile("count", [0.9], 0.0)[0]
    kept = phrases.screen_lists(scored, 0.95, 90.0).agg(F.max("count")).first()[0]
    assert kept == want - 1


@pytest.mark.parametrize("bound", [1000, 0])
def test_phrases_stay_in_their_slice(spark, bound):
    """The same docid in two slices; both the broadcast and the shuffle path."""
    rows = spark.createDataFrame(
        [("m1", "d", ["a", "b", "c"]), ("m2", "d", ["b", "c", "b", "c"]), ("m2", "e", []), ("m2", "f", ["b"])],
        "date string, docid string, tokens array<string>",
    )
    table = scored_table(spark, [("a", "b", 0.9, 5), ("b", "c", 0.9, 9)])
    out = phrases.append_phrases(rows, table, ["date", "docid"], max_broadcast=bound)
    got = {(r["date"], r["docid"]): r["tokens_phrased"] for r in out.collect()}
    assert got == {
        ("m1", "d"): ["a", "b", "c", "a_b", "b_c"],
        ("m2", "d"): ["b", "c", "b", "c", "b_c", "b_c"],
        ("m2", "e"): [],
        ("m2", "f"): ["b"],
    }


def test_empty_phrase_table(spark):
    out = phrases.append_phrases(corpus(spark), scored_table(spark, []), ["date", "docid"])
    assert all(r["tokens"] == r["tokens_phrased"] for r in out.collect())


def test_known_phrases_are_appended_inside_the_rows(spark):
    """No row for each pair and no gathering by key: rows without a key keep their phrases, rows without tokens stay."""
    schema = "date string, docid string, tokens array<string>, n int"
    data = [("m1", None, ["a", "b"], 1), (None, "d", ["b", "a", "b", "c"], 2), ("m1", "d", None, 3), ("m1", "e", ["c", "a"], 4), ("m1", "f", ["b", None, "c"], 5)]
    rows = spark.createDataFrame(data, schema).coalesce(1)
    table = scored_table(spark, [("a", "b", 0.9, 5), ("b", "c", 0.9, 9), ("c", "c", 0.9, 2)])
    out = phrases.append_phrases(rows, table, ["date", "docid"])
    assert out.columns == [*rows.columns, "tokens_phrased"]
    assert {r["n"]: r["tokens_phrased"] for r in out.collect()} == {
        1: ["a", "b", "a_b"], 2: ["b", "a", "b", "c", "a_b", "b_c"], 3: None, 4: ["c", "a"], 5: ["b", None, "c"],
    }
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan and "Join" not in plan


def test_pairs_and_terms_of_many_batches(spark):
    """Counts over batches and partitions against brute force; no row for each pair before the counts."""
    from collections import Counter

    from strata.operators import topics

    words = ["red", "pie", "chat", "lune", "ciel"]
    data = [[words[(i * j + i) % 5] for j in range(i % 7)] for i in range(2000)]
    rows = spark.createDataFrame([(d,) for d in [*data, None]], "tokens array<string>").repartition(3)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        counts = phrases.bigram_counts(rows, min_count=2)
        got = {(r["a"], r["b"]): r["count"] for r in counts.collect()}
        vocabulary = topics.fit_vocabulary(rows, "tokens", size=3, min_df=2, max_df=5000).vocabulary
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert got == {p: n for p, n in Counter(p for d in data for p in zip(d, d[1:])).items() if n >= 2}
    uses = Counter(w for d in data for w in d)
    assert vocabulary == sorted(uses, key=lambda w: (-uses[w], w))[:3]
    assert "Generate" not in counts._jdf.queryExecution().optimizedPlan().toString()
