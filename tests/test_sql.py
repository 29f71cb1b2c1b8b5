"""SQL functions against the column expressions they stand for."""

import pytest
from pyspark.sql import functions as F

from strata import sql
from strata.functions import text as X
from strata.functions import vectors as V
from strata.operators import retrieval

DOCS = [("m1", "doc1", "Red apple, red APPLE pie"), ("m1", "d2", "le chat et l'apple"), ("m2", "doc3", None), ("m2", "d4", "red apple")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "date string, docid string, contents string")


def test_scalars_equal_columns(spark, docs):
    sql.register(spark)
    docs.createOrReplaceTempView("some_docs")
    got = spark.sql(
        "SELECT docid, strata_tokens(contents) AS t, strata_index_tokens(contents) AS i, strata_words(contents) AS w, strata_docid(docid) AS d FROM some_docs"
    )
    want = docs.select(
        "docid", X.simple_tokens("contents").alias("t"), X.light_tokens("contents").alias("i"),
        X.words_by_blank("contents").alias("w"), X.bare_docid("docid").alias("d"),
    )
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    vectors = spark.createDataFrame([([0.5, 0.5], [0.1, 0.9]), ([1.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    vectors.createOrReplaceTempView("some_vectors")
    got = spark.sql("SELECT round(strata_cosine(a, b), 9) AS c, round(strata_hellinger(a, b), 9) AS h FROM some_vectors")
    unit = V.dot(V.unit(F.col("a")), V.unit(F.col("b")))
    roots = V.hellinger_of_roots(V.roots(F.col("a")), V.roots(F.col("b")))
    want = vectors.select(F.round(unit, 9).alias("c"), F.round(roots, 9).alias("h"))
    assert [tuple(r) for r in got.collect()] == [pytest.approx(tuple(r)) for r in want.collect()]


def test_search_from_sql(spark, docs):
    index = retrieval.index_of(docs)
    sql.attach(spark, index, docs)
    queries = spark.createDataFrame([("q1", "red pie"), ("q2", "chat"), ("q3", None), ("q4", "none")], "qid string, query string")
    queries.createOrReplaceTempView("some_queries")
    got = spark.sql("SELECT h.date, qid, docid, score FROM some_queries q, LATERAL strata_search(q.query, 1) h")
    want = retrieval.search(index, queries, ["date", "qid"], 1).select("date", "qid", "docid", "score")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    one = spark.sql("SELECT docid FROM strata_search('red apple', 5) WHERE date = 'm2'").collect()
    assert [r.docid for r in one] == ["d4"]
    phrases = {(r.a, r.b): r.n for r in spark.sql("SELECT * FROM strata_phrases(2)").collect()}
    assert phrases == {("red", "apple"): 3}


def test_search_from_sql_has_no_row_for_each_pair(spark):
    """Slices of more documents than a block, with many equal scores, as the search by columns finds them."""
    words = ["red", "pie", "chat", "lune", "ciel", "soleil", "mer"]
    rows = [
        (f"m{i % 2}", f"d{i}", " ".join(w for j, w in enumerate(words) if (i * 7 + j * j) % (j + 2) == 0) + " x" * (i % 3 if i > 250 else 0))
        for i in range(400)
    ]
    many = spark.createDataFrame(rows, "date string, docid string, contents string")
    index = retrieval.index_of(many)
    sql.attach(spark, index)
    blocks = spark.table("strata_blocks")
    assert blocks.groupBy("date", "term").count().agg(F.max("count")).first()[0] >= 4
    asked = spark.createDataFrame([("q1", "red pie lune"), ("q2", "chat chat mer"), ("q3", "ciel x"), ("q4", "none")], "qid string, query string")
    asked.createOrReplaceTempView("many_queries")
    for n in (3, 70):
        found = spark.sql(f"SELECT h.date, qid, docid, score FROM many_queries q, LATERAL strata_search(q.query, {n}) h")
        want = retrieval.search(index, asked, ["date", "qid"], n).select("date", "qid", "docid", "score")
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    # Scores are summed for blocks: no grouping has a query and a document among its keys.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    keys = [line.split("Aggregate [")[1].split("]")[0] for line in plan.splitlines() if "Aggregate [" in line]
    assert any("query#" in k and "block#" in k for k in keys) and not any("query#" in k and "docid#" in k for k in keys)
