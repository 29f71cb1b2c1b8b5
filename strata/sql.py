"""The library from SQL text: operators as functions of a session.

``register`` creates temporary SQL functions; ``attach`` gives the tables of an
index names and creates table functions over them.  Both are plain SQL, so the
optimizer sees through them: a call costs what the expression costs.

A search adds up scores by blocks of documents: ``attach`` writes the postings once
more, a row for each term of a block, and a query has one row of sums for each block
in which it finds something, not one for each document.

    strata_tokens(text), strata_index_tokens(text), strata_words(text),
    strata_docid(docid), strata_idf(n_docs, df), strata_bm25(weight, tf, dl, avgdl),
    strata_cosine(a, b), strata_hellinger(a, b), strata_npmi(ab, a, b, total)

    strata_search(query, n)    date, docid, score: the best n of every slice
    strata_phrases(least)      a, b, n, npmi: neighbouring words of all documents
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strata.functions import text as X
from strata.functions.words import FRENCH_STOPWORDS
from strata.operators import scoring
from strata.operators.retrieval import K1, B, Index, block_postings
from strata.session import written


def _quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in sorted(set(words)))


def _scalar() -> dict[str, str]:
    """Signature and body of every scalar function."""
    word = X.WORD.replace("\\", "\\\\")
    dot = "aggregate(zip_with({0}, {1}, (x, y) -> x * y), 0.0D, (s, x) -> s + x)"
    return {
        "strata_tokens(t STRING) RETURNS ARRAY<STRING>": f"regexp_extract_all(lower(coalesce(t, '')), '{word}', 0)",
        "strata_index_tokens(t STRING) RETURNS ARRAY<STRING>": f"filter(strata_tokens(t), w -> w NOT IN ({_quoted(FRENCH_STOPWORDS)}))",
        "strata_words(t STRING) RETURNS INT": "size(filter(split(t, '\\\\s+'), w -> w <> ''))",
        "strata_docid(docid STRING) RETURNS STRING": "regexp_replace(docid, '^doc(\\\\d)', '$1')",
        "strata_idf(n_docs BIGINT, df BIGINT) RETURNS DOUBLE": "ln(1 + (n_docs - df + 0.5D) / (df + 0.5D))",
        "strata_bm25(weight DOUBLE, tf INT, dl INT, avgdl DOUBLE) RETURNS DOUBLE": f"weight * tf / (tf + {K1}D * ({1 - B}D + {B}D * dl / avgdl))",
        "strata_cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": f"{dot.format('a', 'b')} / sqrt({dot.format('a', 'a')} * {dot.format('b', 'b')})",
        "strata_hellinger(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "1 - sqrt(aggregate(zip_with(a, b, (x, y) -> power(sqrt(x) - sqrt(y), 2)), 0.0D, (s, x) -> s + x)) / sqrt(2.0D)",
        "strata_npmi(ab BIGINT, a BIGINT, b BIGINT, total BIGINT) RETURNS DOUBLE": "ln(CAST(ab AS DOUBLE) * total / (CAST(a AS DOUBLE) * b)) / -ln(CAST(ab AS DOUBLE) / total)",
    }


def register(spark: SparkSession) -> list[str]:
    """Create the scalar functions in this session; their names."""
    for signature, body in _scalar().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    return [signature.split("(")[0] for signature in _scalar()]


def attach(spark: SparkSession, index: Index, documents: DataFrame | None = None) -> None:
    """Name the tables of ``index`` and create the functions over them.

    ``documents`` (date, docid, contents) are needed for strata_phrases only.
    """
    register(spark)
    for name in ("postings", "term_stats", "slice_stats"):
        getattr(index, name).createOrReplaceTempView(f"strata_{name}")
    # Spelt out: a function inside a table function is not resolved where its argument is a column.
    tokens = _scalar()["strata_tokens(t STRING) RETURNS ARRAY<STRING>"]
    asked = f"filter({tokens.replace('coalesce(t,', 'coalesce(query,')}, w -> w NOT IN ({_quoted(FRENCH_STOPWORDS)}))"
    blocks = written(block_postings(index), "sql-blocks")
    blocks.where("term IS NOT NULL").drop("docids").createOrReplaceTempView("strata_blocks")
    blocks.where("term IS NULL").select("date", "block", "docids").createOrReplaceTempView("strata_block_docs")
    places = range(scoring.BLOCK_DOCS)
    sums = ", ".join(f"sum(weight * get(parts{i // scoring.PIECE_DOCS}, {i % scoring.PIECE_DOCS})) AS s{i}" for i in places)
    pieces = ", ".join(f"b.parts{i}" for i in range(scoring.BLOCK_DOCS // scoring.PIECE_DOCS))
    found = ", ".join(f"CASE WHEN s{i} > 0 THEN named_struct('s', -round(s{i}, 6), 'place', {i}) END" for i in places)
    # The best n documents are in the n blocks with the best documents; blocks that are equal in these stay until
    # their docids are known.  What is broadcast has a row for each query and term, with a weight for each slice.
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION strata_search(query STRING, n INT)
        RETURNS TABLE(date STRING, docid STRING, score DOUBLE) RETURN
        WITH terms AS (SELECT term, count(*) AS qtf FROM (SELECT explode(t) AS term FROM (SELECT {asked} AS t)) GROUP BY term),
        weighed AS (SELECT t.term, map_from_entries(collect_list(struct(t.date, qtf * ln(1 + (n_docs - df + 0.5D) / (df + 0.5D))))) AS weights
          FROM terms JOIN strata_term_stats t USING (term) JOIN strata_slice_stats s ON s.date = t.date GROUP BY t.term),
        held AS (SELECT /*+ BROADCAST(w) */ b.date, b.block, w.weights[b.date] AS weight, {pieces} FROM strata_blocks b JOIN weighed w ON b.term = w.term),
        summed AS (SELECT date, block, {sums} FROM held GROUP BY date, block),
        best AS (SELECT date, block, slice(sort_array(array_compact(array({found}))), 1, n) AS hits FROM summed),
        near AS (SELECT date, block, hits FROM (SELECT *, rank() OVER (PARTITION BY date ORDER BY hits[0].s) AS r FROM best) WHERE r <= n),
        hit AS (SELECT date, block, inline(hits) FROM near),
        named AS (SELECT h.date, d.docids[h.place] AS docid, 0.0D - h.s AS score FROM hit h JOIN strata_block_docs d ON h.date = d.date AND h.block = d.block)
        SELECT date, docid, score FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, docid) AS r FROM named) WHERE r <= n"""
    )
    if documents is not None:
        told = tokens.replace("coalesce(t,", "coalesce(contents,")
        documents.createOrReplaceTempView("strata_documents")
        spark.sql(
            f"""CREATE OR REPLACE TEMPORARY FUNCTION strata_phrases(least INT)
            RETURNS TABLE(a STRING, b STRING, n BIGINT, npmi DOUBLE) RETURN
            WITH told AS (SELECT {told} AS t FROM strata_documents),
            words AS (SELECT w, count(*) AS n FROM (SELECT explode(t) AS w FROM told) GROUP BY w),
            total AS (SELECT sum(n) AS total FROM words),
            pairs AS (SELECT p.a, p.b, count(*) AS n FROM (SELECT explode(zip_with(slice(t, 1, greatest(size(t) - 1, 0)),
              slice(t, 2, greatest(size(t) - 1, 0)), (x, y) -> named_struct('a', x, 'b', y))) AS p FROM told) GROUP BY p.a, p.b)
            SELECT a, b, n, round(ln(CAST(n AS DOUBLE) * total / (CAST(xn AS DOUBLE) * yn)) / -ln(CAST(n AS DOUBLE) / total), 6) AS npmi
            FROM (SELECT p.a, p.b, p.n, x.n AS xn, y.n AS yn, (SELECT total FROM total) AS total FROM pairs p JOIN words x ON x.w = p.a JOIN words y ON y.w = p.b WHERE p.n >= least)"""
        )
