"""Corpus, query-set and run statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions import text as X
from strata.functions import vectors as V
from strata.session import broadcast_if_small


def _r(c, digits: int = 6) -> Column:
    return F.round(c, digits)


# --- documents ---------------------------------------------------------------


def counted(docs: DataFrame, analyzer: X.Analyzer = X.simple_tokens, column: str = "contents") -> DataFrame:
    """Thin projection with token, word and character counts (text dropped)."""
    rest = [c for c in docs.columns if c != column]
    return docs.select(
        *rest,
        X.token_count(column, analyzer).cast("bigint").alias("tokens"),
        X.words_by_space(column).cast("bigint").alias("words"),
        F.length(column).cast("bigint").alias("chars"),
    )


def length_summary(counts: DataFrame, by: list[str]) -> DataFrame:
    return counts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"),
        F.sum("tokens").alias("sum_tokens"),
        _r(F.avg("tokens")).alias("avg_tokens"),
        _r(F.stddev("tokens")).alias("stddev_tokens"),
        _r(F.avg("words")).alias("avg_words"),
        _r(F.stddev("words")).alias("stddev_words"),
    )


def length_sets(counts: DataFrame) -> DataFrame:
    """Token and word sums per (split, language, date) and per (split, language) in one pass."""
    rolled = counts.groupingSets(
        [["split", "language", "date"], ["split", "language"]], "split", "language", "date"
    ).agg(F.sum("tokens").alias("sum_tokens"), F.sum("words").alias("sum_words"))
    return rolled.select(
        "split",
        "language",
        "date",
        "sum_tokens",
        "sum_words",
        (F.col("sum_tokens") / 1e6).alias("sum_tokens_pm"),
        (F.col("sum_words") / 1e6).alias("sum_words_pm"),
    )


def rows_per(df: DataFrame, by: list[str], into: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(into))


def multiplicity(df: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """How many keys occur how often, per ``by`` group."""
    copies = df.groupBy(*by, *key).agg(F.count(F.lit(1)).alias("copies"))
    return copies.groupBy(*by, "copies").agg(F.count(F.lit(1)).alias("n_keys"))


def multiplicity_by_split(df: DataFrame, key: list[str]) -> DataFrame:
    """Mean over dates of the multiplicity histogram, one column per split."""
    hist = multiplicity(df, key, ["split", "date"])
    return hist.groupBy("copies").pivot("split", ["train", "test"]).agg(_r(F.avg("n_keys")))


def copy_consistency(df: DataFrame, key: list[str], column: str = "contents") -> DataFrame:
    """Per repeated key: copies, distinct texts, shortest and longest text."""
    hashed = df.select(*key, F.sha2(F.col(column), 256).alias("h"), F.length(column).alias("l"))
    per_text = hashed.groupBy(*key, "h", "l").agg(F.count(F.lit(1)).alias("n"))
    per_key = per_text.groupBy(*key).agg(
        F.sum("n").alias("copies"),
        F.count(F.lit(1)).alias("texts"),
        F.min("l").cast("bigint").alias("min_chars"),
        F.max("l").cast("bigint").alias("max_chars"),
    )
    return per_key.where(F.col("copies") > 1)


QUANTILES = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


def length_quantiles(counts: DataFrame, by: list[str], column: str, accuracy: int = 10000) -> DataFrame:
    """Mean, deviation and approximate quantiles of a length column."""
    q = F.percentile_approx(column, list(QUANTILES.values()), accuracy)
    rows = counts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_docs"),
        _r(F.avg(column)).alias("mean"),
        _r(F.stddev(column)).alias("stddev"),
        q.alias("q"),
    )
    names = [F.col("q")[i].alias(n) for i, n in enumerate(QUANTILES)]
    return rows.select(*by, "n_docs", "mean", "stddev", *names)


def exact_length_quantiles(counts: DataFrame, by: list[str], column: str) -> DataFrame:
    """Exact interpolated quantiles.  Equal lengths are counted before the
    shuffle, so a group costs as many rows as it has distinct lengths."""
    freq = counts.groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))
    q = F.percentile(column, list(QUANTILES.values()), F.col("n"))
    rows = freq.groupBy(*by).agg(F.sum("n").alias("n_docs"), q.alias("q"))
    return rows.select(*by, "n_docs", *[_r(F.col("q")[i]).alias(n) for i, n in enumerate(QUANTILES)])


def uniqueness(docs: DataFrame, by: list[str], column: str = "contents", rsd: float = 0.01) -> DataFrame:
    """Approximate share of distinct texts."""
    hashed = docs.select(*by, F.sha2(F.col(column), 256).alias("h"))
    rows = hashed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_docs"), F.approx_count_distinct("h", rsd).alias("n_unique")
    )
    return rows.withColumn("unique_frac", _r(F.col("n_unique") / F.col("n_docs")))


def exact_uniqueness(docs: DataFrame, by: list[str], column: str = "contents") -> DataFrame:
    hashed = docs.select(*by, F.sha2(F.col(column), 256).alias("h"))
    per_text = hashed.groupBy(*by, "h").agg(F.count(F.lit(1)).alias("n"))
    rows = per_text.groupBy(*by).agg(
        F.sum("n").alias("n_docs"), F.count(F.lit(1)).alias("n_unique")
    )
    return rows.withColumn("unique_frac", _r(F.col("n_unique") / F.col("n_docs")))


def thin_rows(docs: DataFrame, by: list[str], column: str = "contents") -> DataFrame:
    """What the corpus diagnostics need of every text: one pass over the texts, a few numbers a row."""
    return docs.select(
        *by,
        F.length(column).cast("bigint").alias("chars"),
        F.sha2(F.col(column), 256).alias("text_hash"),
        _r(X.english_density(column), 9).alias("density"),
    )


def diagnostics(thin: DataFrame, by: list[str]) -> DataFrame:
    """Lengths, uniqueness and English density per group, from stored :func:`thin_rows`."""
    means = thin.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_docs"),
        _r(F.avg("chars")).alias("mean_chars"),
        F.max("chars").alias("max_chars"),
        _r(F.avg("density")).alias("density_mean"),
        _r(F.avg((F.col("density") > 0.05).cast("int"))).alias("frac_above_05"),
    )
    texts = thin.groupBy(*by, "text_hash").agg(F.count(F.lit(1)).alias("n"))
    unique = texts.groupBy(*by).agg(F.count(F.lit(1)).alias("n_unique"))
    halves = medians(thin, by, "chars", "median_chars").join(medians(thin, by, "density", "density_p50"), by)
    return means.join(unique, by).join(halves, by)


def english_density(docs: DataFrame, by: list[str], column: str = "contents") -> DataFrame:
    """Distribution of the English-marker share of documents."""
    thin = docs.select(*by, _r(X.english_density(column), 9).alias("d"))
    freq = thin.groupBy(*by, "d").agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    rows = freq.groupBy(*by).agg(
        F.sum("n").alias("n_docs"),
        (F.sum(F.col("d") * n) / F.sum("n")).alias("mean"),
        F.percentile("d", [0.5, 0.95], n).alias("q"),
        (F.sum(F.when(F.col("d") > 0.05, n).otherwise(0)) / F.sum("n")).alias("a05"),
        (F.sum(F.when(F.col("d") > 0.10, n).otherwise(0)) / F.sum("n")).alias("a10"),
    )
    return rows.select(
        *by,
        "n_docs",
        _r("mean").alias("density_mean"),
        _r(F.col("q")[0]).alias("density_p50"),
        _r(F.col("q")[1]).alias("density_p95"),
        _r("a05").alias("frac_above_05"),
        _r("a10").alias("frac_above_10"),
    )


def top_texts(docs: DataFrame, by: list[str], n: int = 3, at_least: int = 50, column: str = "contents") -> DataFrame:
    """Most repeated texts per group, by content hash."""
    per_text = docs.groupBy(*by, F.sha2(F.col(column), 256).alias("hash")).agg(
        F.count(F.lit(1)).alias("n")
    )
    w = Window.partitionBy(*by).orderBy(F.desc("n"), "hash")
    kept = per_text.where(F.col("n") >= at_least)
    return kept.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)


# --- queries -------------------------------------------------------------------


def recurrence(queries: DataFrame) -> DataFrame:
    """How many queries occur in how many slices."""
    months = queries.select("qid", "date").distinct().groupBy("qid").agg(F.count(F.lit(1)).alias("n_months"))
    hist = months.groupBy("n_months").agg(F.count(F.lit(1)).alias("n_qids"))
    return hist.withColumn(
        "share", _r(F.col("n_qids") / hist.agg(F.sum("n_qids").alias("t")).scalar())
    )


def churn(queries: DataFrame) -> DataFrame:
    """Overlap of the query sets of neighbouring slices."""
    inst = queries.select("date", "qid").distinct()
    sizes = inst.groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy("date")  # one row per slice
    steps = sizes.select(
        F.col("date").alias("from_date"),
        F.lead("date").over(order).alias("date"),
        F.col("n").alias("n_from"),
        F.lead("n").over(order).alias("n_to"),
    ).where(F.col("date").isNotNull())
    moved = (
        inst.withColumnRenamed("date", "from_date")
        .join(F.broadcast(steps.select("from_date", "date")), "from_date")
        .join(inst, ["date", "qid"])
        .groupBy("date")
        .agg(F.count(F.lit(1)).alias("n_both"))
    )
    out = steps.join(F.broadcast(moved), "date", "left").withColumn(
        "n_both", F.coalesce("n_both", F.lit(0))
    )
    return out.select(
        "from_date",
        F.col("date").alias("to_date"),
        "n_from",
        "n_to",
        "n_both",
        _r(F.col("n_both") / (F.col("n_from") + F.col("n_to") - F.col("n_both"))).alias("jaccard"),
        _r((F.col("n_to") - F.col("n_both")) / F.col("n_to")).alias("new_share"),
    )


def _query_scope(lengths: DataFrame, by: list[str]) -> DataFrame:
    freq = lengths.groupBy(*by, "words", "tokens", "chars").agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    mean = F.sum(F.col("words") * n) / F.sum("n")
    square = F.sum(F.col("words") * F.col("words") * n) / F.sum("n")
    return freq.groupBy(*by).agg(
        F.sum("n").alias("n"),
        _r(mean).alias("avg_words"),
        F.percentile("words", 0.5, n).alias("med_words"),
        _r(F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))).alias("std_words"),
        _r(F.sum(F.col("tokens") * n) / F.sum("n")).alias("avg_tokens"),
        _r(F.sum(F.col("chars") * n) / F.sum("n")).alias("avg_chars"),
        F.max("words").alias("max_words"),
    )


def query_stats(queries: DataFrame, analyzer: X.Analyzer = X.simple_tokens) -> DataFrame:
    """Word, token and character statistics per date, pooled, and over unique queries."""
    lengths = queries.select(
        "date",
        "qid",
        X.words_by_blank("query").cast("bigint").alias("words"),
        X.token_count("query", analyzer).cast("bigint").alias("tokens"),
        F.length("query").cast("bigint").alias("chars"),
    )
    dated = _query_scope(lengths.withColumn("scope", F.col("date")), ["scope"])
    pooled = _query_scope(lengths.withColumn("scope", F.lit("pooled")), ["scope"])
    once = lengths.groupBy("qid").agg(
        F.min_by(F.struct("words", "tokens", "chars"), F.struct("date", "words", "tokens", "chars")).alias("s")
    ).select(F.lit("unique").alias("scope"), "s.*")
    return dated.unionByName(pooled).unionByName(_query_scope(once, ["scope"]))


def word_count_distribution(queries: DataFrame, column: str = "query") -> DataFrame:
    return queries.groupBy(X.words_by_blank(column).cast("bigint").alias("words")).agg(
        F.count(F.lit(1)).alias("n")
    )


def identifier_stability(queries: DataFrame) -> DataFrame:
    """One row: queries, queries with several texts, queries in both splits."""
    per_text = queries.groupBy("qid", "query").agg(
        F.max(F.when(F.col("split") == "train", 1).otherwise(0)).alias("tr"),
        F.max(F.when(F.col("split") == "test", 1).otherwise(0)).alias("te"),
    )
    per_qid = per_text.groupBy("qid").agg(
        F.count(F.lit(1)).alias("texts"), F.max("tr").alias("tr"), F.max("te").alias("te")
    )
    return per_qid.agg(
        F.count(F.lit(1)).alias("n_qids"),
        F.count(F.when(F.col("texts") > 1, 1)).alias("n_mismatched"),
        F.count(F.when((F.col("tr") == 1) & (F.col("te") == 1), 1)).alias("n_shared"),
    )


# --- runs, scores, topics -----------------------------------------------------------


def scores_by(scores: DataFrame, by: list[str], metric: str) -> DataFrame:
    return scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        _r(F.avg(metric), 4).alias("mean"),
        _r(F.stddev(metric), 4).alias("std"),
    )


def score_pivot(scores: DataFrame, experiments: list[str], metric: str) -> DataFrame:
    """Date by experiment table of metric means; the column list is given, not collected."""
    return scores.groupBy("date").pivot("experiment", experiments).agg(_r(F.avg(metric), 4))


def date_groups(cells: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and deviation over the train dates, the test dates and all dates."""
    labels = F.array(F.col("split"), F.lit("pooled"))
    rows = cells.withColumn("group", F.explode(labels))
    return rows.groupBy("group", *by).agg(
        F.count(F.lit(1)).alias("n_dates"),
        _r(F.avg(value)).alias("mean"),
        _r(F.stddev(value)).alias("std"),
    )


def seed_cells(results: DataFrame, value: str = "ndcg10_mean") -> DataFrame:
    """Mean and deviation over seeds per (date, split, arm)."""
    return results.groupBy("date", "split", "arm").agg(
        F.avg(value).alias("mean"), F.stddev(value).alias("std"), F.count(F.lit(1)).alias("n_seeds")
    )


def throughput(results: DataFrame) -> DataFrame:
    """Mean pairs per second per arm, the unscored baseline left out."""
    return results.where(F.col("arm") != "bm25").groupBy("arm").agg(
        F.round(F.avg("pairs_per_s"), 1).alias("pairs_per_s")
    )


def hits_per_query(run: DataFrame, keys: list[str], k: int) -> DataFrame:
    """One row: queries, hits, distinct documents, share of queries with fewer than ``k`` hits."""
    per_query = run.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("hits"), F.count_distinct("docid").alias("docs")
    )
    return per_query.agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.sum("hits").alias("n_hits"),
        F.sum("docs").alias("n_docs"),
        _r(F.avg((F.col("hits") < k).cast("int"))).alias("share_below_k"),
    )


def score_by_rank(run: DataFrame, ranks: list[int] | None = None) -> DataFrame:
    """Score mean and median by 0-based rank, optionally at fixed ranks only.

    Scores have six digits; the mean is that of whole millionths, rounded half up,
    so it does not depend on the order of the rows."""
    rows = run if ranks is None else run.where(F.col("rank").isin(ranks))
    millionths = F.sum(F.round(F.col("score") * 1_000_000).cast("bigint"))
    sums = rows.groupBy("rank").agg(F.count(F.lit(1)).alias("n"), millionths.alias("__sum"))
    means = sums.select("rank", "n", (F.expr("(2 * __sum + n) div (2 * n)") / 1_000_000).alias("mean_score"))
    middle = medians(rows, ["rank"], "score", "median_score").withColumn("median_score", _r(F.col("median_score")))
    return means.join(middle, "rank")


def score_quantiles(run: DataFrame, digits: int = 4) -> DataFrame:
    """One row of score percentiles; equal rounded scores are counted before the shuffle."""
    freq = run.groupBy(F.round("score", digits).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    marks = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99}
    row = freq.agg(F.percentile("s", list(marks.values()), F.col("n")).alias("q"))
    return row.select(*[_r(F.col("q")[i]).alias(m) for i, m in enumerate(marks)])


def medians(df: DataFrame, by: list[str], value: str, into: str, width: int = 4096) -> DataFrame:
    """Median per group without one task that holds all values of a group.

    Equal values are counted first.  The counts are summed by coarse cells of
    the value, running sums over a group's cells give the cells that hold the
    middle, and only the values of these cells are placed one by one.
    """
    named = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v"))
    counts = named.groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("__n"))
    ends = counts.groupBy(*by).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.sum("__n").alias("__all"))
    span = F.greatest(F.col("__hi") - F.col("__lo"), F.lit(1e-300))
    celled = counts.join(ends, by).withColumn("__cell", F.floor((F.col("__v") - F.col("__lo")) / span * width))
    cells = celled.groupBy(*by, "__cell", "__all").agg(F.sum("__n").alias("__in"))
    upto = Window.partitionBy(*by).orderBy("__cell").rowsBetween(Window.unboundedPreceding, 0)
    low, high = F.floor((F.col("__all") + 1) / 2), F.floor((F.col("__all") + 2) / 2)
    middle = cells.withColumn("__end", F.sum("__in").over(upto)).withColumn("__before", F.col("__end") - F.col("__in"))
    middle = middle.where((F.col("__end") >= low) & (F.col("__before") < high)).select(*by, "__cell", "__before")
    inside = Window.partitionBy(*by, "__cell").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    placed = celled.join(middle, [*by, "__cell"]).withColumn("__last", F.col("__before") + F.sum("__n").over(inside))
    first = F.col("__last") - F.col("__n")

    def at(place):
        return F.max(F.when((F.col("__last") >= place) & (first < place), F.col("__v")))

    return placed.groupBy(*by).agg(((at(low) + at(high)) / 2).alias(into))


def quantiles(df: DataFrame, value: str, shares: list[float], width: int = 4096) -> DataFrame:
    """The smallest values that at least each of ``shares`` of all values do not exceed: share, value.

    Equal values are counted and the counts summed by coarse cells, as for
    ``medians``.  Nulls do not count; without any value all are null.
    """
    named = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("__v"))
    counts = named.groupBy("__v").agg(F.count(F.lit(1)).alias("__n"))
    ends = counts.agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.sum("__n").alias("__all"))
    span = F.greatest(F.col("__hi") - F.col("__lo"), F.lit(1e-300))
    celled = counts.crossJoin(F.broadcast(ends)).withColumn("__cell", F.floor((F.col("__v") - F.col("__lo")) / span * width))
    # One row per cell: width + 1 at most.
    cells = celled.groupBy("__cell", "__all").agg(F.sum("__n").alias("__in"))
    upto = Window.partitionBy("__all").orderBy("__cell").rowsBetween(Window.unboundedPreceding, 0)
    wanted = F.array(*[F.struct(F.lit(q).alias("share"), F.ceil(F.col("__all") * q).alias("__place")) for q in shares])
    middle = cells.withColumn("__end", F.sum("__in").over(upto)).withColumn("__before", F.col("__end") - F.col("__in"))
    middle = middle.select("__cell", "__before", "__end", F.inline(wanted))
    middle = middle.where((F.col("__end") >= F.col("__place")) & (F.col("__before") < F.col("__place"))).drop("__end")
    inside = Window.partitionBy("share", "__cell").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    placed = celled.join(F.broadcast(middle), "__cell").withColumn("__last", F.col("__before") + F.sum("__n").over(inside))
    hit = (F.col("__last") >= F.col("__place")) & (F.col("__last") - F.col("__n") < F.col("__place"))
    asked = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(q) for q in shares])).alias("share"))
    return asked.join(placed.where(hit).select("share", F.col("__v").alias("value")), "share", "left")


def grade_histogram(df: DataFrame) -> DataFrame:
    return df.groupBy("rel").agg(F.count(F.lit(1)).alias("n"))


def dominant_histogram(topics: DataFrame, column: str = "highest_topic") -> DataFrame:
    hist = topics.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return hist.withColumn("share", _r(F.col("n") / F.sum("n").over(Window.partitionBy())))


def crosstab(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Counts of two dominant topics with row share and column purity."""
    cells = pairs.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    row = F.sum("n").over(Window.partitionBy(a))
    column = Window.partitionBy(b)
    return cells.select(
        a,
        b,
        "n",
        _r(F.col("n") / row).alias("row_share"),
        _r(F.max("n").over(column) / F.sum("n").over(column)).alias("column_purity"),
    )


def copy_divergence(thetas: DataFrame, k: int, key: str = "docid", theta: str = "theta") -> DataFrame:
    """One row: how far the topic vectors of copies of a document are apart."""
    spread = thetas.groupBy(key).agg(
        F.count(F.lit(1)).alias("copies"),
        *[F.coalesce(F.stddev(F.col(theta)[i]), F.lit(0.0)).alias(f"s{i}") for i in range(k)],
    )
    widest = spread.select("copies", F.array_max(F.array(*[f"s{i}" for i in range(k)])).alias("m"))
    many = F.col("copies") > 1
    return widest.agg(
        F.count(F.lit(1)).alias("n_docids"),
        F.count(F.when(many, 1)).alias("n_dup"),
        _r(F.avg(many.cast("int"))).alias("dup_share"),
        F.max("copies").alias("max_copies"),
        _r(F.avg(F.when(many, F.col("m")))).alias("mean_max_sd"),
        _r(F.max("m")).alias("worst_max_sd"),
    )


def mean_theta(df: DataFrame, by: list[str], k: int, theta: str = "theta") -> DataFrame:
    """Component means of the topic vector per group, as an array column.

    Written as ``k`` plain averages: rows are not multiplied by ``k``."""
    means = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_docs"),
        *[F.avg(F.col(theta)[i].cast("double")).alias(f"t{i}") for i in range(k)],
    )
    return means.select(*by, "n_docs", F.array(*[f"t{i}" for i in range(k)]).alias(theta))


def topic_mass(df: DataFrame, k: int, theta: str = "theta") -> DataFrame:
    """Sum of the topic vector over all rows, one row per topic."""
    sums = df.agg(*[F.sum(F.col(theta)[i].cast("double")).alias(f"t{i}") for i in range(k)])
    return sums.select(F.posexplode(F.array(*[f"t{i}" for i in range(k)])).alias("topic", "mass"))


def topic_mix(df: DataFrame, by: list[str], k: int, theta: str = "theta") -> DataFrame:
    """Mean topic vector scaled to sum 1, long form."""
    means = mean_theta(df, by, k, theta)
    return means.select(
        *by, "n_docs", F.posexplode(V.normalised(F.col(theta))).alias("topic", "share")
    )


def expansion_coverage(queries: DataFrame, expansions: DataFrame) -> DataFrame:
    """One row: queries with and without an expansion and their word counts."""
    words = X.words_by_blank
    both = queries.select("qid", words("query").alias("q")).join(
        expansions.select("qid", words("query").alias("e")), "qid", "left"
    )
    return both.agg(
        F.count("e").alias("n_expanded"),
        F.count(F.when(F.col("e").isNull(), 1)).alias("n_uncovered"),
        _r(F.avg(F.when(F.col("e").isNotNull(), F.col("q")))).alias("avg_query_words"),
        _r(F.avg("e")).alias("avg_expanded_words"),
        F.max("e").cast("bigint").alias("max_expanded_words"),
    )


# --- logs -----------------------------------------------------------------------------


def elapsed_minutes(events: DataFrame, group: list[str], at: str, into: str = "minutes") -> DataFrame:
    """Add the minutes since the first event of the group; ``at`` is in seconds.

    First events are one row per group, found before events are moved."""
    first = events.groupBy(*group).agg(F.min(at).alias("__first"))
    joined = events.join(broadcast_if_small(first), group)
    return joined.withColumn(into, (F.col(at) - F.col("__first")) / 60).drop("__first")
