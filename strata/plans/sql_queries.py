"""Queries that are SQL text over the library's functions."""

from __future__ import annotations

from strata import sql
from strata.plans import tables as T
from strata.plans.registry import query


def _attached(spark, sf) -> None:
    docs = T.documents(spark, sf)
    sql.attach(spark, T.index(spark, sf), docs)
    T.queries(spark, sf).createOrReplaceTempView("strata_queries")


@query(
    "sql_search",
    "X1 R2",
    f"WITH {T.RUN} SELECT date, qid, docid, score FROM run WHERE rank < 10",
)
def sql_search(spark, sf):
    """The best ten documents of every query and slice, asked in SQL."""
    _attached(spark, sf)
    return spark.sql("SELECT h.date, q.qid, h.docid, h.score FROM strata_queries q, LATERAL strata_search(q.query, 10) h")


@query(
    "sql_phrases",
    "X1 T5 T6",
    f"""WITH {T.DOCS}, told AS (SELECT {T.WORDS.format('contents')} AS t FROM docs),
    words AS (SELECT w, count(*) AS n FROM (SELECT unnest(t) AS w FROM told) GROUP BY w),
    total AS (SELECT sum(n) AS total FROM words),
    pairs AS (SELECT a, b, count(*) AS n FROM (SELECT t[i] AS a, t[i + 1] AS b FROM (SELECT t, unnest(range(1, len(t))) AS i FROM told WHERE len(t) > 1))
      GROUP BY a, b HAVING count(*) >= 5)
    SELECT a, b, p.n, round(ln(p.n::DOUBLE * total / (x.n::DOUBLE * y.n)) / -ln(p.n::DOUBLE / total), 6) AS npmi
    FROM pairs p JOIN words x ON x.w = a JOIN words y ON y.w = b, total""",
)
def sql_phrases(spark, sf):
    """Neighbouring words that occur five times or more, asked in SQL."""
    _attached(spark, sf)
    return spark.sql("SELECT a, b, n, npmi FROM strata_phrases(5)")


@query(
    "sql_surface",
    "X1 X2 A19",
    f"""WITH {T.DOCS}, told AS (SELECT date, regexp_replace(docid, '^doc([0-9])', '\\1') AS docid, len({T.WORDS.format('contents')}) AS tokens,
      len(list_filter(regexp_split_to_array(contents, '\\s+'), lambda w: w <> '')) AS words FROM docs)
    SELECT date, count(DISTINCT docid) AS n, sum(tokens)::BIGINT AS tokens, quantile_disc(words, 0.5)::INT AS median_words, max(words)::INT AS most_words
    FROM told GROUP BY date""",
)
def sql_surface(spark, sf):
    """Analysis and quantiles from SQL text only."""
    _attached(spark, sf)
    return spark.sql(
        """SELECT date, count(DISTINCT docid) AS n, sum(tokens) AS tokens, CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY words) AS INT) AS median_words,
        max(words) AS most_words
        FROM (SELECT date, strata_docid(docid) AS docid, size(strata_tokens(contents)) AS tokens, strata_words(contents) AS words FROM strata_documents)
        GROUP BY date"""
    )
