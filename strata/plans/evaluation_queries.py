"""Evaluation of runs and signal probes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators import clean, evaluate, stats
from strata.plans import retrieval_queries as R
from strata.plans import tables as T
from strata.plans.registry import query
from strata.session import spread_join

ON = ["date", "qid", "docid"]
KEYS = ["date", "qid"]

JUDGED = f"{T.RUN}, {T.QRELS}"


def metric_sql(run: str, into: str, keys: str, ideal: str = "retrieved") -> str:
    """CTEs that evaluate ``run(keys, docid, score)`` against ``qrels``."""
    if ideal == "retrieved":
        ideals = f"""SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY rel DESC) AS pos, rel FROM {into}_judged"""
        known = ""
    else:
        ideals = f"""SELECT {keys}, pos, rel FROM (SELECT DISTINCT {keys} FROM {into}_judged) JOIN (
          SELECT date, qid, row_number() OVER (PARTITION BY date, qid ORDER BY rel DESC) AS pos, rel FROM qrels) USING (date, qid)"""
        known = "WHERE (date, qid) IN (SELECT (date, qid) FROM qrels)"
    return f"""{into}_judged AS (SELECT {keys}, docid, score, coalesce(rel, 0) AS rel
    FROM {run} LEFT JOIN qrels USING (date, qid, docid) {known}),
{into}_pos AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, docid DESC) AS pos FROM {into}_judged),
{into}_ideal AS ({ideals}),
{into}_at AS (SELECT {keys}, pos, coalesce(sum(g), 0) AS gain, coalesce(sum(i), 0) AS ideal FROM (
    SELECT {keys}, pos, rel AS g, 0 AS i FROM {into}_pos UNION ALL
    SELECT {keys}, pos, 0 AS g, rel AS i FROM {into}_ideal WHERE rel > 0) GROUP BY {keys}, pos),
{into}_cum AS (SELECT *, sum(gain / log2(pos + 1)) OVER w AS dcg, sum(ideal / log2(pos + 1)) OVER w AS idcg,
    sum(CASE WHEN gain > 0 THEN 1 ELSE 0 END) OVER w AS hits FROM {into}_at
    WINDOW w AS (PARTITION BY {keys} ORDER BY pos ROWS UNBOUNDED PRECEDING)),
{into} AS (SELECT {keys},
    round(coalesce(sum(gain / log2(pos + 1)) / nullif(sum(ideal / log2(pos + 1)), 0), 0), 6) AS ndcg,
    round(coalesce(sum(CASE WHEN ideal > 0 THEN dcg / idcg ELSE 0 END) / nullif(count(*) FILTER (ideal > 0), 0), 0), 6) AS ndcg_rel,
    round(coalesce(sum(gain / log2(pos + 1)) FILTER (pos <= 10) / nullif(sum(ideal / log2(pos + 1)) FILTER (pos <= 10), 0), 0), 6) AS ndcg_cut_10,
    round(coalesce(sum(CASE WHEN gain > 0 THEN hits / pos ELSE 0 END) / nullif(count(*) FILTER (ideal > 0), 0), 0), 6) AS map
    FROM {into}_cum GROUP BY {keys})"""


SCORES = f"{JUDGED}, {metric_sql('run', 'scores', 'date, qid')}"
STRICT = f"{JUDGED}, {metric_sql('run', 'strict', 'date, qid', 'judged')}"


def scores(spark, sf, ideal: str = "retrieved") -> DataFrame:
    return evaluate.evaluate(T.run(spark, sf), T.stored_qrels(spark, sf), KEYS, ON, ideal)


def summary_sql(source: str, by: str) -> str:
    return f"""SELECT {by}, count(*) AS n_queries, round(avg(ndcg), 6) AS ndcg, round(avg(ndcg_rel), 6) AS ndcg_rel,
    round(avg(ndcg_cut_10), 6) AS ndcg_cut_10, round(avg(map), 6) AS map, round(stddev(ndcg_cut_10), 6) AS ndcg10_std
    FROM {source} GROUP BY {by}"""


@query("qrels", "D3", f"WITH {T.DOCS}, {T.POSED}, {T.QRELS} SELECT date, qid, docid, rel FROM qrels")
def qrels(spark, sf):
    return T.qrels(spark, sf)


@query(
    "judge_run",
    "J1 P4 P10",
    f"WITH {JUDGED} SELECT date, qid, regexp_replace(docid, '^doc([0-9])', '\\1') AS docid, score, coalesce(rel, 0) AS rel FROM run LEFT JOIN qrels USING (date, qid, docid)",
)
def judge_run(spark, sf):
    rows = evaluate.judge(T.run(spark, sf), T.stored_qrels(spark, sf), ON)
    return rows.select("date", "qid", "docid", "score", "rel")


@query(
    "run_maps",
    "J1 E1",
    f"""WITH {JUDGED}, judged AS (SELECT date, qid, docid, score, coalesce(rel, 0) AS rel FROM run LEFT JOIN qrels USING (date, qid, docid))
    SELECT date, qid, count(*) AS n_hits, count(*) FILTER (rel > 0) AS n_relevant, round(coalesce(sum(score) FILTER (rel > 0), 0), 4) AS relevant_score,
    round(max(score), 6) AS best, min(docid) AS first_docid FROM judged GROUP BY date, qid""",
)
def run_maps(spark, sf):
    """Runs and judgements as maps by docid, asked by key."""
    judged = evaluate.judge(T.run(spark, sf), T.stored_qrels(spark, sf), ON)
    maps = evaluate.as_maps(judged.withColumn("docid", F.concat(F.lit("doc"), "docid")), KEYS)
    relevant = F.map_keys(F.map_filter("rels", lambda _, rel: rel > 0))
    found = F.aggregate(relevant, F.lit(0.0), lambda total, docid: total + F.element_at("scores", docid))
    return maps.select(
        *KEYS,
        F.size("scores").cast("bigint").alias("n_hits"),
        F.size(relevant).cast("bigint").alias("n_relevant"),
        F.round(found, 4).alias("relevant_score"),
        F.round(F.array_max(F.map_values("scores")), 6).alias("best"),
        F.array_min(F.map_keys("scores")).alias("first_docid"),
    )


@query("ndcg_map", "E1 D16", f"WITH {SCORES} SELECT * FROM scores")
def ndcg_map(spark, sf):
    return scores(spark, sf)


@query("ndcg_strict", "E2", f"WITH {STRICT} SELECT * FROM strict")
def ndcg_strict(spark, sf):
    return scores(spark, sf, "judged")


# Lists cut at ten: judged documents lie below the cut.
CUT = "cut AS (SELECT * FROM run WHERE rank < 10)"


def cut_scores(spark, sf, ideal: str) -> DataFrame:
    run = T.run(spark, sf).where(F.col("rank") < 10)
    return evaluate.evaluate(run, T.stored_qrels(spark, sf), KEYS, ON, ideal)


@query("ndcg_of_cut_lists", "E1", f"WITH {JUDGED}, {CUT}, {metric_sql('cut', 'scores', 'date, qid')} SELECT * FROM scores")
def ndcg_of_cut_lists(spark, sf):
    return cut_scores(spark, sf, "retrieved")


@query("strict_ndcg_of_cut_lists", "E2", f"WITH {JUDGED}, {CUT}, {metric_sql('cut', 'strict', 'date, qid', 'judged')} SELECT * FROM strict")
def strict_ndcg_of_cut_lists(spark, sf):
    return cut_scores(spark, sf, "judged")


@query("retrieval_quality", "R2 E1 A6", f"WITH {SCORES} {summary_sql('scores', 'date')}")
def retrieval_quality(spark, sf):
    """Flagship: search, judge and evaluate, summarised per slice."""
    return evaluate.summary(scores(spark, sf), ["date"])


@query(
    "pooled_quality",
    "A8",
    f"""WITH {SCORES} SELECT count(*) AS n, round(avg(ndcg_cut_10), 6) AS mean, round(stddev(ndcg_cut_10), 6) AS std FROM scores""",
)
def pooled_quality(spark, sf):
    return scores(spark, sf).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("ndcg_cut_10"), 6).alias("mean"),
        F.round(F.stddev("ndcg_cut_10"), 6).alias("std"),
    )


@query(
    "missing_as_zero",
    "E1 R7",
    f"""WITH {SCORES}, log AS (SELECT slices.date, qid FROM posed, slices)
    SELECT date, count(*) AS n, round(avg(coalesce(ndcg_cut_10, 0)), 6) AS ndcg_cut_10 FROM log LEFT JOIN scores USING (date, qid) GROUP BY date""",
)
def missing_as_zero(spark, sf):
    rows = evaluate.with_missing(scores(spark, sf), R.sliced_queries(spark, sf), KEYS)
    return rows.groupBy("date").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("ndcg_cut_10"), 6).alias("ndcg_cut_10")
    )


EXPERIMENTS = ["bm25", "topic", "fusion_0.1", "fusion_0.3", "fusion_0.5"]
FUSED = f"""{R.FUSED}, {T.QRELS},
rfused AS (SELECT date, qid, docid, arm, round(score, 6) AS score FROM fused),
{metric_sql('rfused', 'fscores', 'date, qid, arm')}"""


def fused_scores(spark, sf) -> DataFrame:
    return evaluate.evaluate(R.fused(spark, sf), T.stored_qrels(spark, sf), ["date", "qid", "arm"], ON)


@query("fusion_scores", "R5 E4", f"WITH {FUSED} {summary_sql('fscores', 'arm')}")
def fusion_scores(spark, sf):
    return evaluate.summary(fused_scores(spark, sf), ["arm"])


@query(
    "recovered_loss",
    "E9",
    f"""WITH {FUSED}, means AS ({summary_sql('fscores', 'arm')}), arms AS (SELECT max(ndcg_cut_10) FILTER (arm = 'bm25') AS best,
    max(ndcg_cut_10) FILTER (arm = 'topic') AS worse, max(ndcg_cut_10) FILTER (arm = 'fusion_0.5') AS again FROM means)
    SELECT round(best - worse, 6) AS loss, round((again - worse) / nullif(best - worse, 0), 6) AS recovered FROM arms""",
)
def recovered_loss(spark, sf):
    """What topics lose against words, and the share that their fusion wins back."""
    means = evaluate.summary(fused_scores(spark, sf), ["arm"])
    return evaluate.recovered(means, "bm25", "topic", "fusion_0.5", "ndcg_cut_10")


@query(
    "scores_by_date",
    "A6 E4",
    f"""WITH {FUSED} SELECT arm AS experiment, date, count(*) AS n, round(avg(ndcg_cut_10), 4) AS mean,
    round(stddev(ndcg_cut_10), 4) AS std FROM fscores GROUP BY arm, date""",
)
def scores_by_date(spark, sf):
    rows = fused_scores(spark, sf).withColumnRenamed("arm", "experiment")
    return stats.scores_by(rows, ["experiment", "date"], "ndcg_cut_10")


@query(
    "score_pivot",
    "A7",
    "WITH "
    + FUSED
    + " SELECT date, "
    + ", ".join(f"round(avg(map) FILTER (arm = '{e}'), 4) AS \"{e}\"" for e in EXPERIMENTS)
    + " FROM fscores GROUP BY date",
)
def score_pivot(spark, sf):
    rows = fused_scores(spark, sf).withColumnRenamed("arm", "experiment")
    return stats.score_pivot(rows, EXPERIMENTS, "map")


@query(
    "metric_pairs",
    "J14",
    f"""WITH {FUSED} SELECT count(*) AS n_queries, round(avg(a.map), 6) AS base, round(avg(b.map), 6) AS other,
    {T.rounded('avg(b.map - a.map)')} AS change
    FROM fscores a JOIN fscores b USING (date, qid) WHERE a.arm = 'bm25' AND b.arm = 'topic'""",
)
def metric_pairs(spark, sf):
    return evaluate.metric_change(fused_scores(spark, sf), "bm25", "topic", KEYS, "map")


@query(
    "date_groups",
    "A23",
    f"""WITH {FUSED}, cells AS (SELECT date, arm, CASE WHEN date <= '{T.LAST_TRAIN}' THEN 'train' ELSE 'test' END AS split,
      avg(ndcg_cut_10) AS v FROM fscores GROUP BY date, arm)
    SELECT "group", arm, count(*) AS n_dates, round(avg(v), 6) AS mean, round(stddev(v), 6) AS std FROM (
      SELECT split AS "group", arm, v FROM cells UNION ALL SELECT 'pooled', arm, v FROM cells) GROUP BY "group", arm""",
)
def date_groups(spark, sf):
    from strata.functions import keys as K

    cells = fused_scores(spark, sf).groupBy("date", "arm").agg(F.avg("ndcg_cut_10").alias("v"))
    cells = cells.withColumn("split", K.split_of(F.col("date"), T.LAST_TRAIN))
    return stats.date_groups(cells, ["arm"], "v")


@query(
    "expansion_effect",
    "E8",
    f"""WITH {R.EXPANDED}, {T.matches_sql('posed', 'matches')}, {T.QRELS},
    orun AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date, qid ORDER BY score DESC, docid) - 1 AS rank
      FROM matches) WHERE rank < 10),
    arms AS (SELECT date, qid, docid, score, 'original' AS arm FROM orun UNION ALL
             SELECT date, qid, docid, score, 'expanded' AS arm FROM erun),
    {metric_sql('arms', 'ascores', 'date, qid, arm')}
    SELECT count(*) AS n_queries, round(avg(a.map), 6) AS base, round(avg(b.map), 6) AS other,
    {T.rounded('avg(b.map - a.map)')} AS change
    FROM ascores a JOIN ascores b USING (date, qid) WHERE a.arm = 'original' AND b.arm = 'expanded'""",
)
def expansion_effect(spark, sf):
    original = T.run(spark, sf).where(F.col("rank") < 10).withColumn("arm", F.lit("original"))
    expanded = R.expanded_run(spark, sf).withColumn("arm", F.lit("expanded"))
    both = clean.union_all([original, expanded])
    done = evaluate.evaluate(both, T.stored_qrels(spark, sf), ["date", "qid", "arm"], ON)
    return evaluate.metric_change(done, "original", "expanded", KEYS, "map")


GRID = f"""{R.GRID_SQL}, {T.QRELS}, {metric_sql('grun', 'gscores', 'n_terms, weight, date, qid')}"""


def grid_scores(spark, sf) -> DataFrame:
    return evaluate.evaluate(
        R.grid_run(spark, sf), T.stored_qrels(spark, sf), ["n_terms", "weight", "date", "qid"], ON
    )


@query("grid_scores", "R4 E1", f"WITH {GRID} {summary_sql('gscores', 'n_terms, weight')}")
def grid_quality(spark, sf):
    return evaluate.summary(grid_scores(spark, sf), ["n_terms", "weight"])


@query(
    "best_terms",
    "O5",
    f"""WITH {GRID}, best AS (SELECT n_terms, round(avg(ndcg_cut_10), 6) AS score FROM gscores GROUP BY n_terms)
    SELECT n_terms, score FROM best ORDER BY score DESC, n_terms LIMIT 1""",
)
def best_terms(spark, sf):
    cells = grid_scores(spark, sf).groupBy("n_terms").agg(F.round(F.avg("ndcg_cut_10"), 6).alias("score"))
    return evaluate.best_of(cells, "score", "n_terms")


@query(
    "binary_ndcg",
    "E3",
    f"""WITH {JUDGED},
    j AS (SELECT date, qid, docid, score, CASE WHEN coalesce(rel, 0) > 0 THEN 1.0 ELSE 0.0 END AS rel FROM run LEFT JOIN qrels USING (date, qid, docid)),
    p AS (SELECT date, qid, rel, avg(rel) OVER (PARTITION BY date, qid, score) AS gain,
      row_number() OVER (PARTITION BY date, qid ORDER BY score DESC, docid DESC) AS pos,
      row_number() OVER (PARTITION BY date, qid ORDER BY rel DESC, docid DESC) AS best FROM j)
    SELECT date, qid, CAST(sum(rel) AS BIGINT) AS rel_count, round(CASE WHEN count(*) = 1 THEN max(rel)
      ELSE coalesce(sum(gain / log2(pos + 1)) / nullif(sum(rel / log2(best + 1)), 0), 0) END, 6) AS ndcg FROM p GROUP BY date, qid""",
)
def binary_ndcg(spark, sf):
    return evaluate.binary_ndcg(T.run(spark, sf), T.stored_qrels(spark, sf), KEYS, ON)


@query(
    "grade_histogram",
    "A11",
    f"""WITH {JUDGED} SELECT 'qrels' AS "source", rel, count(*) AS n FROM qrels GROUP BY rel
    UNION ALL SELECT 'run', coalesce(rel, 0), count(*) FROM run LEFT JOIN qrels USING (date, qid, docid) GROUP BY 2""",
)
def grade_histogram(spark, sf):
    judged = evaluate.judge(T.run(spark, sf), T.stored_qrels(spark, sf), ON)
    return clean.union_all(
        [
            stats.grade_histogram(T.stored_qrels(spark, sf)).withColumn("source", F.lit("qrels")),
            stats.grade_histogram(judged).withColumn("source", F.lit("run")),
        ]
    )


@query(
    "relevant_sets",
    "J10",
    f"""WITH {T.DOCS}, {T.POSED}, {T.QRELS} SELECT posed.qid, md5(query) AS query_hash, date, docid FROM posed JOIN qrels USING (qid) WHERE rel > 0""",
)
def relevant_sets(spark, sf):
    """Queries with their relevant documents, one row per document."""
    wanted = T.stored_qrels(spark, sf).where(F.col("rel") > 0).select("qid", "date", "docid").distinct()
    posed = T.queries(spark, sf).select("qid", F.md5("query").alias("query_hash"))
    return spread_join(wanted, posed, ["qid"]).select("qid", "query_hash", "date", "docid")


@query(
    "judged_documents",
    "J9",
    f"""WITH {T.DOCS}, {T.POSED}, {T.QRELS} SELECT date, docid, length(contents) AS chars FROM docs
    WHERE (date, docid) IN (SELECT (date, docid) FROM qrels)""",
)
def judged_documents(spark, sf):
    judged = T.stored_qrels(spark, sf).select("date", "docid").distinct()
    rows = T.documents(spark, sf).select("date", "docid", F.length("contents").cast("bigint").alias("chars"))
    return rows.join(judged, ["date", "docid"], "left_semi")


@query(
    "run_summary",
    "E5",
    f"""WITH {SCORES} SELECT date, n_pairs, n_queries, m AS ndcg10_mean, s AS ndcg10_std, CAST(floor(n_pairs / n_queries) AS BIGINT) AS k_candidates
    FROM (SELECT date, count(*) AS n_pairs, count(DISTINCT qid) AS n_queries FROM run GROUP BY date)
    JOIN (SELECT date, round(avg(ndcg_cut_10), 6) AS m, round(stddev(ndcg_cut_10), 6) AS s FROM scores GROUP BY date) USING (date)""",
)
def run_summary(spark, sf):
    return evaluate.run_summary(scores(spark, sf), T.run(spark, sf), ["date"])


# --- signal probes -------------------------------------------------------------------

PAIRS = f"""{T.DOCS}, {T.POSED}, {T.QRELS}, {T.THETAS},
pairs AS (SELECT r.qid, r.rel,
  round(list_dot_product(q.theta, d.theta) / (sqrt(list_dot_product(q.theta, q.theta)) * sqrt(list_dot_product(d.theta, d.theta))), 6) AS cos,
  round(1 - sqrt(list_sum(list_transform(list_zip(q.theta, d.theta), lambda z: (sqrt(z[1]) - sqrt(z[2])) ** 2))) / sqrt(2.0), 6) AS hell
  FROM qrels r JOIN thetas q ON q.qid = r.qid JOIN thetas d ON d.docid = r.docid)"""


def probe_pairs(spark, sf) -> DataFrame:
    """Judged pairs with the similarity of their topic vectors."""
    judged = T.stored_qrels(spark, sf)
    return T.compared(spark, sf, judged.select("qid", "docid", "rel"), judged)


def auc_sql(source: str, score: str, keys: str = "") -> str:
    """Mean of (wins + half ties) over all pairs of a positive and a negative."""
    by = f"{keys}, " if keys else ""
    over = f"PARTITION BY {keys} " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {by}CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(n) AS BIGINT) AS n_neg,
      round(sum(p * (below - n + n / 2.0)) / (sum(p) * sum(n)), 6) AS auc FROM (
        SELECT {by}s, p, n, sum(n) OVER ({over}ORDER BY s) AS below FROM (
          SELECT {by}{score} AS s, count(*) FILTER (rel > 0) AS p, count(*) FILTER (rel <= 0) AS n
          FROM {source} GROUP BY {by}{score})) {group} HAVING sum(p) > 0 AND sum(n) > 0"""


@query("cosine_by_grade", "A29 J8", f"WITH {PAIRS} SELECT rel, count(*) AS n, round(avg(cos), 6) AS mean_cos FROM pairs GROUP BY rel")
def cosine_by_grade(spark, sf):
    return probe_pairs(spark, sf).groupBy("rel").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("cos"), 6).alias("mean_cos")
    )


@query("auc_pooled", "E6 J8", f"WITH {PAIRS} {auc_sql('pairs', 'cos')}")
def auc_pooled(spark, sf):
    return evaluate.auc(probe_pairs(spark, sf), [], "cos")


@query("auc_hellinger", "E6", f"WITH {PAIRS} {auc_sql('pairs', 'hell')}")
def auc_hellinger(spark, sf):
    return evaluate.auc(probe_pairs(spark, sf), [], "hell")


@query("auc_by_query", "E6", f"WITH {PAIRS} {auc_sql('pairs', 'cos', 'qid')}")
def auc_by_query(spark, sf):
    return evaluate.auc(probe_pairs(spark, sf), ["qid"], "cos")


@query(
    "auc_macro",
    "E6",
    f"WITH {PAIRS} SELECT count(*) AS n_queries, round(avg(auc), 6) AS macro_auc FROM ({auc_sql('pairs', 'cos', 'qid')})",
)
def auc_macro(spark, sf):
    return evaluate.macro_auc(probe_pairs(spark, sf), "cos")


CONTROL = f"""{JUDGED}, {T.THETAS}, {T.TOPICAL},
seen AS (SELECT rel, bm25, topic FROM topical JOIN qrels USING (date, qid, docid))"""


@query(
    "positive_control",
    "E7",
    f"""WITH {CONTROL} SELECT 'bm25' AS signal, * FROM ({auc_sql('seen', 'bm25')})
    UNION ALL SELECT 'topic' AS signal, * FROM ({auc_sql('seen', 'topic')})""",
)
def positive_control(spark, sf):
    rows = T.topical(spark, sf).join(T.stored_qrels(spark, sf), ON)
    signals = F.array(
        F.struct(F.lit("bm25").alias("signal"), F.col("bm25").alias("score")),
        F.struct(F.lit("topic").alias("signal"), F.col("topic").alias("score")),
    )
    long = rows.select("rel", F.explode(signals).alias("s")).select("rel", "s.*")
    return evaluate.auc(long, ["signal"], "score")


@query(
    "kendall_tau",
    "W13",
    f"""WITH {T.RUN}, {T.THETAS}, {T.TOPICAL},
    pr AS (SELECT a.date, a.qid, sign(a.bm25 - b.bm25) * sign(a.topic - b.topic) AS c, a.bm25 = b.bm25 AS tx, a.topic = b.topic AS ty
      FROM topical a JOIN topical b ON a.date = b.date AND a.qid = b.qid AND a.docid < b.docid),
    g AS (SELECT date, qid, count(*) AS n FROM topical GROUP BY date, qid
          HAVING count(*) > 2 AND count(DISTINCT bm25) > 1 AND count(DISTINCT topic) > 1)
    SELECT date, qid, any_value(g.n) AS n, {T.rounded('sum(c) / sqrt(CAST(count(*) FILTER (NOT tx) AS DOUBLE) * count(*) FILTER (NOT ty))')} AS tau
    FROM pr JOIN g USING (date, qid) GROUP BY date, qid""",
)
def kendall_tau(spark, sf):
    return evaluate.kendall_tau(T.topical(spark, sf), KEYS, "bm25", "topic")
