"""Index, search, expansion, candidate and fusion queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions import text as X
from strata.operators import clean, models, pruned, retrieval, segments, stats
from strata.plans import tables as T
from strata.plans.registry import query

GRID_TERMS = [0, 3, 6]
GRID_WEIGHTS = [1, 2, 4]
MAX_TERMS = 12
WEIGHT = 2


def expansions(spark, sf) -> DataFrame:
    """Extra terms per query: the pieces of all turns of the conversation, in order."""
    turns = T.table(spark, sf, "conversations").groupBy(F.col("conv_id").cast("string").alias("qid")).agg(
        F.array_sort(F.collect_list(F.struct("turn", F.split("text", r"[.,\n]+").alias("pieces")))).alias("turns")
    )
    return turns.select("qid", F.flatten(F.transform("turns", lambda t: t["pieces"])).alias("terms"))


def with_terms(spark, sf) -> DataFrame:
    return T.queries(spark, sf).join(expansions(spark, sf), "qid", "left").withColumn(
        "terms", F.coalesce("terms", F.array().cast("array<string>"))
    )


# New terms: trimmed, first of each case-folded spelling, some word not in the query.
NEW_TERMS = rf"""{T.POSED},
raw_terms AS (SELECT qid, turn * 1000000 + pos AS pos, trim(t) AS term FROM (
  SELECT CAST(conv_id AS VARCHAR) AS qid, turn, generate_subscripts(p, 1) AS pos, unnest(p) AS t
  FROM (SELECT conv_id, turn, regexp_split_to_array(text, '[.,\n]+') AS p FROM conversations))),
adding AS (SELECT qid, pos, term FROM raw_terms JOIN posed USING (qid)
  WHERE term <> '' AND len(list_filter(regexp_split_to_array(lower(term), '\s+'),
    lambda w: w <> '' AND NOT list_contains(regexp_split_to_array(lower(query), '\s+'), w))) > 0),
uniq AS (SELECT qid, term, row_number() OVER (PARTITION BY qid ORDER BY pos) AS r FROM (
  SELECT *, row_number() OVER (PARTITION BY qid, lower(term) ORDER BY pos) AS again FROM adding) WHERE again = 1)"""


def merged_sql(into: str, max_terms: str, weight: str, cells: str = "", keys: str = "qid") -> str:
    cell_join = f", {cells}" if cells else ""
    return f"""{into} AS (SELECT {keys}, trim(repeat(query || ' ', {weight}) || coalesce(
      (SELECT string_agg(term, ' ' ORDER BY r) FROM uniq u WHERE u.qid = posed.qid AND r <= {max_terms}), '')) AS query
      FROM posed{cell_join})"""


@query(
    "postings",
    "R1",
    f"WITH {T.INDEXED} SELECT date, docid, term, CAST(tf AS INTEGER) AS tf, CAST(dl AS INTEGER) AS dl FROM postings",
)
def postings(spark, sf):
    return retrieval.postings(T.documents(spark, sf))


@query("term_stats", "R1", f"WITH {T.INDEXED} SELECT date, term, df FROM dfs")
def term_stats(spark, sf):
    return T.index(spark, sf).term_stats


@query(
    "slice_stats",
    "R1",
    f"WITH {T.INDEXED} SELECT date, n_docs, round(avgdl, 6) AS avgdl FROM slices",
)
def slice_stats(spark, sf):
    return T.index(spark, sf).slice_stats.withColumn("avgdl", F.round("avgdl", 6))


@query(
    "query_matches",
    "J13",
    f"""WITH {T.INDEXED}, {T.POSED}, {T.matches_sql('posed', 'matches')}
    SELECT date, qid, count(*) AS n, round(sum(score), 6) AS total, round(max(score), 6) AS best FROM matches GROUP BY date, qid""",
)
def query_matches(spark, sf):
    scored = retrieval.score_matches(T.index(spark, sf), T.queries(spark, sf), ["date", "qid"])
    return scored.groupBy("date", "qid").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("score"), 6).alias("total"),
        F.round(F.max("score"), 6).alias("best"),
    )


@query(
    "bm25_topk",
    "R2 O2 J13 R7 D14",
    f"WITH {T.RUN} SELECT date, qid, CAST(rank AS INTEGER) AS rank, docid, score FROM run WHERE rank < 10",
)
def bm25_topk(spark, sf):
    return retrieval.search(T.index(spark, sf), T.queries(spark, sf), ["date", "qid"], k=10)


@query(
    "bm25_pruned",
    "R2 O2 J13 R1",
    f"WITH {T.RUN} SELECT date, qid, CAST(rank AS INTEGER) AS rank, docid, score FROM run WHERE rank < 10",
)
def bm25_pruned(spark, sf):
    """The rows of ``bm25_topk``, by bounds of blocks over an index that has replaced and compacted documents."""
    return pruned.search(T.store(spark, sf), T.queries(spark, sf), ["date", "qid"], k=10)


def tokens_sql(column: str) -> str:
    return f"list_filter({T.WORDS.format(column)}, lambda w: w NOT IN ({T.STOP}))"


@query(
    "phrase_matches",
    "R1",
    f"""WITH {T.DOCS}, {T.POSED},
    told AS (SELECT date, docid, {tokens_sql('contents')} AS t FROM docs),
    phrases AS (SELECT qid, t[1] AS a, t[2] AS b FROM (SELECT qid, {tokens_sql('query')} AS t FROM posed) WHERE len(t) > 1),
    pairs AS (SELECT date, docid, t[i] AS a, t[i + 1] AS b FROM (SELECT *, unnest(range(1, len(t))) AS i FROM told WHERE len(t) > 1))
    SELECT qid, date, docid, count(*) AS n FROM pairs JOIN phrases USING (a, b) GROUP BY qid, date, docid""",
)
def phrase_matches(spark, sf):
    """Documents that hold the first two terms of a query one after the other."""
    terms = T.queries(spark, sf).select("qid", X.light_tokens("query").alias("t")).where(F.size("t") > 1)
    phrases = terms.select("qid", F.array_join(F.slice("t", 1, 2), " ").alias("phrase"))
    return segments.phrase_matches(T.store(spark, sf), phrases, ["qid"])


@query(
    "document_vectors",
    "R1",
    f"""WITH {T.INDEXED} SELECT date, docid, CAST(any_value(dl) AS INTEGER) AS dl, count(*) AS n_terms,
    md5(string_agg(term || ':' || tf, ' ' ORDER BY term)) AS terms_hash FROM postings GROUP BY date, docid""",
)
def document_vectors(spark, sf):
    vectors = segments.document_vectors(T.store(spark, sf))
    told = F.transform("terms", lambda t: F.concat_ws(":", t["term"], t["tf"].cast("string")))
    return vectors.select(
        "date", "docid", "dl", F.size("terms").cast("long").alias("n_terms"), F.md5(F.array_join(told, " ")).alias("terms_hash")
    )


@query(
    "feedback_terms",
    "R1 R3",
    f"""WITH {T.RUN}, shares AS (SELECT date, qid, term, sum(CAST(tf AS DOUBLE) / dl) / 10 AS share
      FROM run JOIN postings USING (date, docid) WHERE rank < 10 GROUP BY date, qid, term),
    weighed AS (SELECT date, qid, term, round(share * ln(1 + (n_docs - df + 0.5) / (df + 0.5)), 6) AS weight
      FROM shares JOIN dfs USING (date, term) JOIN slices USING (date))
    SELECT date, qid, term, weight FROM (SELECT *, row_number() OVER (PARTITION BY date, qid ORDER BY weight DESC, term) AS r FROM weighed)
    WHERE r <= 5""",
)
def feedback_terms(spark, sf):
    """Terms of the first ten documents that weigh most."""
    first = T.run(spark, sf).where(F.col("rank") < 10)
    return segments.feedback_terms(T.store(spark, sf), first, ["date", "qid"], n_docs=10, n_terms=5)


@query(
    "search_response",
    "D15 J11",
    f"""WITH {T.RUN} SELECT date, qid, count(*) AS hits, max(score) AS max_score,
    max(CASE WHEN rank = 0 THEN docid END) AS first, md5(string_agg(docid, ' ' ORDER BY rank)) AS order_hash
    FROM run GROUP BY date, qid""",
)
def search_response(spark, sf):
    keys = ["date", "qid"]
    nested = retrieval.as_responses(T.run(spark, sf), keys, "bm25")
    return nested.select(
        *keys,
        F.col("total.value").alias("hits"),
        "max_score",
        F.get("hits", F.lit(0))["_id"].alias("first"),
        F.md5(F.array_join(F.transform("hits", lambda h: h["_id"]), " ")).alias("order_hash"),
    )


@query(
    "response_rows",
    "J11 D15",
    f"WITH {T.RUN} SELECT date, qid, CAST(rank AS INTEGER) AS rank, docid, score FROM run",
)
def response_rows(spark, sf):
    keys = ["date", "qid"]
    nested = retrieval.as_responses(T.run(spark, sf), keys, "bm25")
    arrays = nested.select(
        *keys,
        F.transform("hits", lambda h: h["_id"]).alias("ids"),
        F.transform("hits", lambda h: h["_score"]).alias("scores"),
    )
    return retrieval.from_hit_arrays(arrays, keys, "ids", "scores")


@query(
    "merge_expansion",
    "R3 D18",
    f"""WITH {NEW_TERMS}, {merged_sql('merged', str(MAX_TERMS), str(WEIGHT))}
    SELECT qid, md5(query) AS query_hash, length(query) AS chars FROM merged""",
)
def merge_expansion(spark, sf):
    merged = retrieval.merge_expansion(with_terms(spark, sf), MAX_TERMS, WEIGHT)
    return merged.select("qid", F.md5("query").alias("query_hash"), F.length("query").cast("bigint").alias("chars"))


@query(
    "expanded_queries",
    "J2",
    f"""WITH {T.POSED}, {T.WHOLE}
    SELECT qid, md5(coalesce(text, query)) AS query_hash FROM posed LEFT JOIN whole USING (qid)""",
)
def expanded_queries(spark, sf):
    out = retrieval.expanded_or_original(T.queries(spark, sf), T.whole_conversations(spark, sf))
    return out.select("qid", F.md5("query").alias("query_hash"))


EXPANDED = f"""{T.INDEXED}, {NEW_TERMS}, {merged_sql('merged', str(MAX_TERMS), str(WEIGHT))},
{T.matches_sql('merged', 'ematches')},
erun AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date, qid ORDER BY score DESC, docid) - 1 AS rank
  FROM ematches) WHERE rank < 10)"""


def expanded_run(spark, sf, k: int = 10) -> DataFrame:
    merged = retrieval.merge_expansion(with_terms(spark, sf), MAX_TERMS, WEIGHT).select("qid", "query")
    return retrieval.search(T.index(spark, sf), merged, ["date", "qid"], k=k)


@query(
    "expanded_bm25",
    "R3 R2",
    f"WITH {EXPANDED} SELECT date, qid, CAST(rank AS INTEGER) AS rank, docid, score FROM erun",
)
def expanded_bm25(spark, sf):
    return expanded_run(spark, sf)


GRID_SQL = f"""{T.INDEXED}, {NEW_TERMS},
cells AS (SELECT n_terms, weight FROM (SELECT unnest({GRID_TERMS}) AS n_terms), (SELECT unnest({GRID_WEIGHTS}) AS weight)),
{merged_sql('grid', 'n_terms', 'weight', 'cells', 'qid, n_terms, weight')},
{T.matches_sql('grid', 'gmatches', 'n_terms, weight, qid')},
grun AS (SELECT * FROM (SELECT *, row_number() OVER (
  PARTITION BY n_terms, weight, date, qid ORDER BY score DESC, docid) - 1 AS rank FROM gmatches) WHERE rank < 10)"""


def grid_run(spark, sf) -> DataFrame:
    cells = retrieval.expansion_grid(with_terms(spark, sf), GRID_TERMS, GRID_WEIGHTS)
    posed = cells.select("n_terms", "weight", "qid", "query")
    grid = [(n, w) for n in GRID_TERMS for w in GRID_WEIGHTS]
    return retrieval.search_cells(T.index(spark, sf), posed, ["n_terms", "weight"], grid, k=10)


@query(
    "expansion_grid",
    "R4",
    f"""WITH {GRID_SQL} SELECT n_terms, weight, count(*) AS n, count(DISTINCT qid) AS n_queries, round(avg(score), 4) AS mean_score,
    count(*) FILTER (rank = 0) AS n_lists FROM grun GROUP BY n_terms, weight""",
)
def expansion_grid(spark, sf):
    return grid_run(spark, sf).groupBy("n_terms", "weight").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("qid").alias("n_queries"),
        F.round(F.avg("score"), 4).alias("mean_score"),
        F.count(F.when(F.col("rank") == 0, 1)).alias("n_lists"),
    )


@query(
    "search_shards",
    "R6",
    f"""WITH {EXPANDED}, {T.matches_sql('posed', 'matches')},
    arms AS (SELECT 'original' AS arm, * FROM (SELECT *, row_number() OVER (PARTITION BY date, qid ORDER BY score DESC, docid) - 1 AS rank
      FROM matches) WHERE rank < 10 UNION ALL BY NAME SELECT 'expanded' AS arm, * FROM erun)
    SELECT arm, date, qid, CAST(rank AS INTEGER) AS rank, docid, score, CAST({T.crc32_sql('qid')} % 8 AS INTEGER) AS sample_id FROM arms""",
)
def search_shards(spark, sf):
    merged = retrieval.merge_expansion(with_terms(spark, sf), MAX_TERMS, WEIGHT).select("qid", "query")
    arms = {"original": T.queries(spark, sf), "expanded": merged}
    return retrieval.search_shards(T.index(spark, sf), arms, shards=8, k=10)


@query(
    "hits_per_query",
    "A10",
    f"""WITH {T.RUN} SELECT count(*) AS n_queries, CAST(sum(hits) AS BIGINT) AS n_hits, CAST(sum(docs) AS BIGINT) AS n_docs,
    round(avg(CASE WHEN hits < {T.RUN_DEPTH} THEN 1 ELSE 0 END), 6) AS share_below_k FROM (
      SELECT date, qid, count(*) AS hits, count(DISTINCT docid) AS docs FROM run GROUP BY date, qid)""",
)
def hits_per_query(spark, sf):
    return stats.hits_per_query(T.run(spark, sf), ["date", "qid"], T.RUN_DEPTH)


@query(
    "score_by_rank",
    "A28",
    f"""WITH {T.RUN} SELECT CAST(rank AS INTEGER) AS rank, count(*) AS n,
    ((2 * sum(round(score * 1000000)::BIGINT) + count(*)) // (2 * count(*)))::DOUBLE / 1000000 AS mean_score,
    round(quantile_cont(score, 0.5), 6) AS median_score FROM run GROUP BY rank""",
)
def score_by_rank(spark, sf):
    return stats.score_by_rank(T.run(spark, sf))


@query(
    "score_at_ranks",
    "W14 A28",
    f"""WITH {T.RUN} SELECT CAST(rank AS INTEGER) AS rank, count(*) AS n,
    ((2 * sum(round(score * 1000000)::BIGINT) + count(*)) // (2 * count(*)))::DOUBLE / 1000000 AS mean_score,
    round(quantile_cont(score, 0.5), 6) AS median_score FROM run WHERE rank IN (0, 1, 4, 9, 24, 49, 99) GROUP BY rank""",
)
def score_at_ranks(spark, sf):
    return stats.score_by_rank(T.run(spark, sf), [0, 1, 4, 9, 24, 49, 99])


@query(
    "score_quantiles",
    "A28",
    f"""WITH {T.RUN}, s AS (SELECT round(score, 4) AS s FROM run) SELECT round(quantile_cont(s, 0.01), 6) AS p01,
    round(quantile_cont(s, 0.25), 6) AS p25, round(quantile_cont(s, 0.5), 6) AS p50,
    round(quantile_cont(s, 0.75), 6) AS p75, round(quantile_cont(s, 0.99), 6) AS p99 FROM s""",
)
def score_quantiles(spark, sf):
    return stats.score_quantiles(T.run(spark, sf))


@query(
    "run_file",
    "W4 K4 O1",
    f"""WITH {T.RUN} SELECT date, qid, 'Q0' AS "Q0", docid AS docno,
    CAST(row_number() OVER (PARTITION BY date, qid ORDER BY score DESC, docid) AS INTEGER) AS rank, score,
    'strata_bm25' AS tag FROM run""",
)
def run_file(spark, sf):
    return retrieval.submission(T.run(spark, sf), ["date", "qid"], "strata_bm25")


@query(
    "candidates_left",
    "J3 R8",
    f"""WITH {T.RUN} SELECT run.date, qid, docid, md5(query) AS query_hash, md5(contents) AS text_hash, score
    FROM run LEFT JOIN docs USING (date, docid) LEFT JOIN posed USING (qid)""",
)
def candidates_left(spark, sf):
    rows = retrieval.candidates(T.run(spark, sf), T.documents(spark, sf), sliced_queries(spark, sf), "left")
    return rows.select("date", "qid", "docid", F.md5("query").alias("query_hash"), F.md5("contents").alias("text_hash"), "score")


def sliced_queries(spark, sf) -> DataFrame:
    """Every query posed to every slice of the index."""
    dates = T.index(spark, sf).slice_stats.agg(F.collect_set("date")).scalar()  # one per slice
    return T.queries(spark, sf).withColumn("date", F.explode(dates))


@query(
    "candidates_inner",
    "J4 R8",
    f"""WITH {T.RUN} SELECT run.date, count(*) AS n, CAST(sum(length(contents)) AS BIGINT) AS chars, round(sum(score), 6) AS score
    FROM run JOIN docs USING (date, docid) JOIN posed USING (qid) WHERE length(contents) > 50 GROUP BY run.date""",
)
def candidates_inner(spark, sf):
    kept = clean.keep_longest(T.documents(spark, sf), ["date", "docid"])
    rows = retrieval.candidates(T.run(spark, sf), kept, sliced_queries(spark, sf))
    return rows.groupBy("date").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.length("contents")).alias("chars"),
        F.round(F.sum("score"), 6).alias("score"),
    )


WORD_SET = "list_distinct(list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda w: w <> ''))"


@query(
    "rerank",
    "M5 R8",
    f"""WITH {T.RUN}, pairs AS (SELECT run.date, qid, docid, {WORD_SET.format('query')} AS q, {WORD_SET.format('contents')} AS c
    FROM run JOIN docs USING (date, docid) JOIN posed USING (qid))
    SELECT date, qid, docid, round(len(list_intersect(q, c)) / greatest(len(q), 1), 6) AS score FROM pairs""",
)
def rerank(spark, sf):
    rows = retrieval.candidates(T.run(spark, sf), T.documents(spark, sf), sliced_queries(spark, sf))
    return models.rerank(rows, models.overlap_scorer()).select("date", "qid", "docid", "score")


@query(
    "minmax",
    "W12",
    f"""WITH {T.RUN} SELECT date, qid, docid, round((score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w + 1e-12), 6) AS scaled
    FROM run WINDOW w AS (PARTITION BY date, qid)""",
)
def minmax(spark, sf):
    rows = retrieval.minmax(T.run(spark, sf), ["date", "qid"], "score", "scaled")
    return rows.select("date", "qid", "docid", F.round("scaled", 6).alias("scaled"))


FUSED = f"""{T.RUN}, {T.THETAS}, {T.TOPICAL},
scaled AS (SELECT date, qid, docid, bm25, topic,
  (bm25 - min(bm25) OVER w) / (max(bm25) OVER w - min(bm25) OVER w + 1e-12) AS b,
  (topic - min(topic) OVER w) / (max(topic) OVER w - min(topic) OVER w + 1e-12) AS t
  FROM topical WINDOW w AS (PARTITION BY date, qid)),
fused AS (
  SELECT date, qid, docid, 'bm25' AS arm, bm25 AS score FROM scaled UNION ALL
  SELECT date, qid, docid, 'topic', topic FROM scaled UNION ALL
  SELECT date, qid, docid, 'fusion_0.1', 0.9 * b + 0.1 * t FROM scaled UNION ALL
  SELECT date, qid, docid, 'fusion_0.3', 0.7 * b + 0.3 * t FROM scaled UNION ALL
  SELECT date, qid, docid, 'fusion_0.5', 0.5 * b + 0.5 * t FROM scaled)"""


def fused(spark, sf) -> DataFrame:
    rows = retrieval.fuse(T.topical(spark, sf), ["date", "qid"], [0.1, 0.3, 0.5])
    return rows.withColumn("score", F.round("score", 6))


@query("fusion", "R5 W12", f"WITH {FUSED} SELECT date, qid, docid, arm, round(score, 6) AS score FROM fused")
def fusion(spark, sf):
    return fused(spark, sf)


@query(
    "arm_overlap",
    "E9",
    f"""WITH {EXPANDED}, {T.matches_sql('posed', 'matches')},
    orun AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date, qid ORDER BY score DESC, docid) - 1 AS rank
      FROM matches) WHERE rank < 10)
    SELECT date, qid, count(o.docid) AS n_a, count(e.docid) AS n_b, count(*) FILTER (o.docid IS NOT NULL AND e.docid IS NOT NULL) AS n_both,
    round(count(*) FILTER (o.docid IS NOT NULL AND e.docid IS NOT NULL) / nullif(count(o.docid), 0), 6) AS overlap
    FROM (SELECT date, qid, docid, docid AS d FROM orun) o FULL JOIN (SELECT date, qid, docid, docid AS d FROM erun) e
    USING (date, qid, d) GROUP BY date, qid""",
)
def arm_overlap(spark, sf):
    original = T.run(spark, sf).where(F.col("rank") < 10)
    return retrieval.overlap(original, expanded_run(spark, sf), ["date", "qid"])
