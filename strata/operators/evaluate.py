"""Run evaluation: nDCG, MAP, AUC, rank correlation.

A run holds the best k documents per query, so a per-query window is bounded
by k.  Judgement tables and pooled scores have no such bound; they are counted
per grade or per score before anything is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions import text as X
from strata.operators.ranking import positions, running_sums
from strata.session import spread_join

METRICS = ["ndcg", "ndcg_rel", "ndcg_cut_10", "map"]


def _bare(df: DataFrame) -> DataFrame:
    return df.withColumn("docid", X.bare_docid("docid"))


def judge(run: DataFrame, qrels: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Run rows with their grade; unjudged documents get 0."""
    on = on or ["qid", "docid"]
    grades = _bare(qrels).groupBy(*on).agg(F.max("rel").alias("rel"))
    joined = _bare(run).join(grades, on, "left")
    return joined.withColumn("rel", F.coalesce("rel", F.lit(0)))


def _ideal_positions(grades: DataFrame, keys: list[str], limit_to: DataFrame | None = None) -> DataFrame:
    """Positions of the relevant documents in the ideal order of each query.

    Only grades matter for the ideal, so documents are numbered inside salted
    (query, grade) groups and shifted by the sizes of the groups before them.
    """
    relevant = grades.where(F.col("rel") > 0)
    salt = F.pmod(F.xxhash64("docid"), F.lit(64))
    bucket = F.struct((-F.col("rel")).alias("g"), salt.alias("s"))
    placed = positions(relevant, keys, bucket, [F.asc("docid")], "pos")
    return placed.select(*keys, F.col("pos").cast("bigint").alias("pos"), F.col("rel").alias("ideal"))


def evaluate(
    run: DataFrame,
    qrels: DataFrame,
    keys: list[str],
    on: list[str] | None = None,
    ideal: str = "retrieved",
    digits: int = 6,
) -> DataFrame:
    """Per-query ``ndcg, ndcg_rel, ndcg_cut_10, map``.

    ``keys`` identify a query of the run (experiment, date, qid); ``on`` are
    the columns shared with the judgements.  ``ideal='retrieved'`` takes the
    judged set to be the retrieved documents, ``ideal='judged'`` takes all
    judgements of the query and leaves out queries without any.  Documents are
    ranked by score, ties by descending docid.
    """
    on = on or ["qid", "docid"]
    scored = judge(run, qrels, on)
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("docid"))
    ranked = scored.select(
        *keys, "docid", F.col("rel").cast("double").alias("rel"), F.row_number().over(order).cast("bigint").alias("pos")
    )
    if ideal == "retrieved":
        best = Window.partitionBy(*keys).orderBy(F.desc("rel"), F.desc("docid"))
        both = ranked.withColumn("best", F.row_number().over(best).cast("bigint"))
        cells = both.select(
            *keys,
            F.explode(
                F.array(
                    F.struct("pos", F.col("rel").alias("gain"), F.lit(0.0).alias("ideal")),
                    F.struct(F.col("best").alias("pos"), F.lit(0.0).alias("gain"), F.col("rel").alias("ideal")),
                )
            ).alias("c"),
        ).select(*keys, "c.*")
    else:
        shared = [c for c in on if c != "docid"]
        grades = _bare(qrels).groupBy(*on).agg(F.max("rel").cast("double").alias("rel"))
        known = grades.select(*shared).distinct()
        ranked = ranked.join(known, shared, "left_semi")
        posed = ranked.select(*keys).distinct()
        ideals = _ideal_positions(grades, shared)
        # A query is posed once per experiment, its judgements can be many.
        runs = posed.groupBy(*shared).agg(F.collect_set(F.struct(*keys)).alias("__runs"))
        wanted = spread_join(ideals, runs, shared).select(
            F.explode("__runs").alias("r"), "pos", F.lit(0.0).alias("gain"), "ideal"
        )
        cells = ranked.select(*keys, "pos", F.col("rel").alias("gain"), F.lit(0.0).alias("ideal")).unionByName(
            wanted.select("r.*", "pos", "gain", "ideal")
        )
    at = cells.groupBy(*keys, "pos").agg(F.sum("gain").alias("gain"), F.sum("ideal").alias("ideal"))
    discount = F.log2(F.col("pos") + 1.0)
    parts = at.select(
        *keys,
        "pos",
        "ideal",
        (F.col("gain") / discount).alias("g"),
        (F.col("ideal") / discount).alias("i"),
        (F.col("gain") > 0).cast("int").alias("hit"),
    )
    wanted = {"dcg": F.col("g"), "idcg": F.col("i"), "hits": F.col("hit")}
    if ideal == "retrieved":  # no more positions than retrieved documents
        upto = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        summed = parts.select("*", *[F.sum(c).over(upto).alias(n) for n, c in wanted.items()])
    else:
        summed = running_sums(parts, keys, "pos", wanted)
    relevant = F.sum((F.col("ideal") > 0).cast("int"))
    first10 = F.col("pos") <= 10

    def ratio(top: Column, bottom: Column) -> Column:
        return F.round(F.coalesce(F.try_divide(top, bottom), F.lit(0.0)), digits)

    return summed.groupBy(*keys).agg(
        ratio(F.sum("g"), F.sum("i")).alias("ndcg"),
        ratio(
            F.sum(F.when(F.col("ideal") > 0, F.try_divide("dcg", "idcg")).otherwise(0.0)), relevant
        ).alias("ndcg_rel"),
        ratio(F.sum(F.when(first10, F.col("g"))), F.sum(F.when(first10, F.col("i")))).alias("ndcg_cut_10"),
        ratio(
            F.sum(F.when(F.col("hit") == 1, F.col("hits") / F.col("pos")).otherwise(0.0)), relevant
        ).alias("map"),
    )


def with_missing(scores: DataFrame, queries: DataFrame, keys: list[str]) -> DataFrame:
    """Count queries without any hit as 0 in every metric."""
    return queries.select(*keys).distinct().join(scores, keys, "left").na.fill(0.0, METRICS)


def summary(scores: DataFrame, by: list[str], digits: int = 6) -> DataFrame:
    """Queries and metric means per group, metric deviations for nDCG@10."""
    return scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_queries"),
        *[F.round(F.avg(m), digits).alias(m) for m in METRICS],
        F.round(F.stddev("ndcg_cut_10"), digits).alias("ndcg10_std"),
    )


def best_of(sweep: DataFrame, value: str, choose: str) -> DataFrame:
    """One row: the parameter value with the highest score and that score."""
    return sweep.agg(
        F.max_by(choose, F.struct(value, (-F.col(choose)).alias("low"))).alias(choose),
        F.max(value).alias(value),
    )


def metric_change(scores: DataFrame, base: str, other: str, on: list[str], metric: str) -> DataFrame:
    """Mean of a metric of two arms over the queries both have scored."""
    a = scores.where(F.col("arm") == base).select(*on, F.col(metric).alias("__a"))
    b = scores.where(F.col("arm") == other).select(*on, F.col(metric).alias("__b"))
    return a.join(b, on).agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.round(F.avg("__a"), 6).alias("base"),
        F.round(F.avg("__b"), 6).alias("other"),
        F.round(F.avg(F.col("__b") - F.col("__a")), 6).alias("change"),
    )


def as_maps(judged: DataFrame, keys: list[str]) -> DataFrame:
    """Judged run rows as two maps per query: ``keys``, scores (docid -> score), rels (docid -> rel).

    A map has at most the rows that the search kept for its query.  A docid that
    stands twice in a query keeps its highest score."""
    each = judged.groupBy(*keys, "docid").agg(F.max("score").alias("score"), F.max("rel").alias("rel"))
    return each.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("docid", "score"))).alias("scores"),
        F.map_from_entries(F.collect_list(F.struct("docid", "rel"))).alias("rels"),
    )


def recovered(summaries: DataFrame, best: str, worse: str, reranked: str, metric: str) -> DataFrame:
    """Share of the loss between two arms that a third arm wins back."""
    def arm(name: str) -> Column:
        return F.max(F.when(F.col("arm") == name, F.col(metric)))

    return summaries.agg(
        F.round(arm(best) - arm(worse), 6).alias("loss"),
        F.round(F.try_divide(arm(reranked) - arm(worse), arm(best) - arm(worse)), 6).alias("recovered"),
    )


def run_summary(scores: DataFrame, run: DataFrame, by: list[str], wall_seconds: float | None = None) -> DataFrame:
    """Mean and deviation of nDCG@10, pairs, candidates per query and throughput."""
    pairs = run.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pairs"), F.count_distinct("qid").alias("n_queries"))
    quality = scores.groupBy(*by).agg(
        F.round(F.avg("ndcg_cut_10"), 6).alias("ndcg10_mean"),
        F.round(F.stddev("ndcg_cut_10"), 6).alias("ndcg10_std"),
    )
    out = pairs.join(quality, by).withColumn(
        "k_candidates", F.floor(F.col("n_pairs") / F.greatest(F.col("n_queries"), F.lit(1)))
    )
    if wall_seconds:
        out = out.withColumn("pairs_per_s", F.round(F.col("n_pairs") / F.lit(wall_seconds), 1))
    return out


# --- binary nDCG with tied scores ---------------------------------------------------


def binary_ndcg(run: DataFrame, qrels: DataFrame, keys: list[str], on: list[str] | None = None) -> DataFrame:
    """nDCG with grades reduced to 0/1, tied scores sharing their gain, and a
    single retrieved document scored by its own relevance."""
    scored = judge(run, qrels, on).withColumn("rel", (F.col("rel") > 0).cast("double"))
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("docid"))
    best = Window.partitionBy(*keys).orderBy(F.desc("rel"), F.desc("docid"))
    tied = Window.partitionBy(*keys, "score")
    rows = scored.select(
        *keys,
        "rel",
        F.row_number().over(order).alias("pos"),
        F.row_number().over(best).alias("best"),
        F.avg("rel").over(tied).alias("gain"),
    )
    dcg = F.sum(F.col("gain") / F.log2(F.col("pos") + 1.0))
    idcg = F.sum(F.col("rel") / F.log2(F.col("best") + 1.0))
    value = F.when(F.count(F.lit(1)) == 1, F.max("rel")).otherwise(
        F.coalesce(F.try_divide(dcg, idcg), F.lit(0.0))
    )
    return rows.groupBy(*keys).agg(
        F.round(value, 6).alias("ndcg"), F.sum("rel").cast("bigint").alias("rel_count")
    )


def hit_table(run: DataFrame, queries: DataFrame, keys: list[str]) -> DataFrame:
    """Queries without hits as well, with a hit count."""
    hits = run.groupBy(*keys).agg(F.count(F.lit(1)).alias("hits"))
    return queries.select(*keys).distinct().join(hits, keys, "left").withColumn(
        "hits", F.coalesce("hits", F.lit(0))
    )


# --- AUC ------------------------------------------------------------------------------


def auc(pairs: DataFrame, group: list[str], score: str = "score", positive: str = "rel", digits: int = 6) -> DataFrame:
    """Area under the ROC curve per group, ties counted half; one-class groups drop out.

    Scores are rounded and counted per distinct value before any ordering.
    Values are then numbered in buckets of at most 1000 neighbouring values,
    so neither a pooled set nor a large group is sorted in one task.
    """
    s = F.round(F.col(score).cast("double"), digits)
    values = pairs.groupBy(*group, s.alias("s")).agg(
        F.sum((F.col(positive) > 0).cast("bigint")).alias("p"),
        F.sum((F.col(positive) <= 0).cast("bigint")).alias("n"),
    )
    values = values.withColumn("bucket", F.floor(F.col("s") * (10.0 ** max(digits - 3, 0))))
    sums = values.groupBy(*group, "bucket").agg(F.sum("n").alias("bn"))
    before = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*group, "bucket", F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("below"))
    inside = Window.partitionBy(*group, "bucket").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = values.withColumn("here", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(
        offsets, [*group, "bucket"]
    )
    wins = F.sum(F.col("p") * (F.col("below") + F.col("here") + F.col("n") / 2.0))
    out = ranked.groupBy(*group).agg(
        F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"), wins.alias("wins")
    )
    out = out.where((F.col("n_pos") > 0) & (F.col("n_neg") > 0))
    return out.select(
        *group,
        "n_pos",
        "n_neg",
        F.round(F.col("wins") / (F.col("n_pos") * F.col("n_neg")), digits).alias("auc"),
    )


def macro_auc(pairs: DataFrame, score: str = "score", key: list[str] | None = None) -> DataFrame:
    """Mean of the per-query AUC over queries that have both classes."""
    return auc(pairs, key or ["qid"], score).agg(
        F.count(F.lit(1)).alias("n_queries"), F.round(F.avg("auc"), 6).alias("macro_auc")
    )


# --- Kendall tau -------------------------------------------------------------------------


def kendall_tau(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Tau-b of two scores per query, for queries with more than two rows and
    more than one value on each side.

    Discordant pairs are counted as the inversions of ``b`` in the order of
    ``a``, one bit of the position at a time: at each bit, an element of a
    right half is inverted with the larger elements of its left half.  That is
    n log n rows instead of all pairs.
    """
    rows = df.select(*keys, F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
    group = Window.partitionBy(*keys)
    order = group.orderBy("x", "y")
    placed = rows.select(
        *keys,
        "y",
        (F.row_number().over(order) - 1).alias("pos"),
        F.count(F.lit(1)).over(group).alias("size"),
    )
    top_bit = F.greatest(F.ceil(F.log2(F.col("size").cast("double"))).cast("int") - 1, F.lit(0))
    bits = placed.withColumn("bit", F.explode(F.sequence(F.lit(0), top_bit)))
    halves = bits.select(
        *keys,
        "y",
        "bit",
        F.expr("shiftright(pos, bit + 1)").alias("block"),
        F.expr("shiftright(pos, bit) & 1").alias("right"),
    )
    larger = Window.partitionBy(*keys, "bit", "block").orderBy(F.desc("y"), F.desc("right")).rowsBetween(
        Window.unboundedPreceding, 0
    )
    left_seen = F.sum(1 - F.col("right")).over(larger)
    discordant = (
        halves.withColumn("seen", left_seen)
        .groupBy(*keys)
        .agg(F.sum(F.when(F.col("right") == 1, F.col("seen")).otherwise(0)).alias("d"))
    )

    def pairs(n: Column) -> Column:
        return n * (n - 1) / 2.0

    xy = rows.groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("c"))
    by_x = xy.groupBy(*keys, "x").agg(F.sum("c").alias("c")).groupBy(*keys).agg(
        F.sum(pairs(F.col("c"))).alias("tx"), F.sum("c").alias("n"), F.count(F.lit(1)).alias("ux")
    )
    by_y = xy.groupBy(*keys, "y").agg(F.sum("c").alias("c")).groupBy(*keys).agg(
        F.sum(pairs(F.col("c"))).alias("ty"), F.count(F.lit(1)).alias("uy")
    )
    by_xy = xy.groupBy(*keys).agg(F.sum(pairs(F.col("c"))).alias("txy"))
    t = by_x.join(by_y, keys).join(by_xy, keys).join(discordant, keys)
    t = t.where((F.col("n") > 2) & (F.col("ux") > 1) & (F.col("uy") > 1))
    n0 = pairs(F.col("n"))
    top = n0 - F.col("tx") - F.col("ty") + F.col("txy") - 2.0 * F.col("d")
    return t.select(
        *keys, "n", F.round(top / F.sqrt((n0 - F.col("tx")) * (n0 - F.col("ty"))), 6).alias("tau")
    )
