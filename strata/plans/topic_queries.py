"""Topic proportions, drift, topic models and embeddings."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions import vectors as V
from strata.operators import clean, coherence, drift, models, phrases, stats, topics
from strata.plans import tables as T
from strata.plans import text_queries as Q
from strata.plans.registry import query
from strata.session import written

K = T.TOPICS
CHANGE = T.CHANGE

PROPS = f"""{T.THETAS},
long AS (SELECT docid, qid, date, label, generate_subscripts(theta, 1) - 1 AS topic, unnest(theta) AS v FROM thetas),
props AS (SELECT {K} AS k, date, CAST(topic AS INTEGER) AS topic, avg(v) AS mean_theta, count(*) AS n_docs FROM long GROUP BY date, topic)"""


def proportions(spark, sf) -> DataFrame:
    return drift.slice_proportions(T.topics(spark, sf), K)


def r(*names: str, digits: int = 6):
    return [F.round(n, digits).alias(n) for n in names]


@query(
    "slice_proportions",
    "A13 T18 D11",
    f"WITH {PROPS} SELECT k, date, topic, round(mean_theta, 8) AS mean_theta, n_docs FROM props",
)
def slice_proportions(spark, sf):
    return proportions(spark, sf).withColumn("mean_theta", F.round("mean_theta", 8))


# Copies of one text share a docid (its hash); vectors of copies are averaged.
COPIES = f"""{T.DOCS}, {T.THETAS},
copies AS (SELECT md5(contents) AS docid, docs.date, theta FROM docs JOIN thetas ON docs.docid = thetas.docid),
clong AS (SELECT docid, generate_subscripts(theta, 1) - 1 AS topic, unnest(theta) AS v FROM copies)"""


def copies(spark, sf) -> DataFrame:
    docs = T.documents(spark, sf).select("docid", "date", F.md5("contents").alias("h"))
    vectors = T.topics(spark, sf).select("docid", "theta")
    return docs.join(vectors, "docid").select(F.col("h").alias("docid"), "date", "theta")


@query(
    "mean_theta_by_docid",
    "A12",
    f"""WITH {COPIES} SELECT docid, CAST(topic AS INTEGER) AS topic, count(*) AS n_docs, round(avg(v), 6) AS theta
    FROM clong GROUP BY docid, topic""",
)
def mean_theta_by_docid(spark, sf):
    rows = stats.mean_theta(copies(spark, sf), ["docid"], K)
    return rows.select("docid", "n_docs", F.posexplode("theta").alias("topic", "v")).select(
        "docid", "topic", "n_docs", F.round("v", 6).alias("theta")
    )


@query(
    "proportions_by_docid",
    "J7 T18",
    f"""WITH {COPIES}, m AS (SELECT docid, topic, avg(v) AS v FROM clong GROUP BY docid, topic)
    SELECT {K} AS k, date, CAST(topic AS INTEGER) AS topic, round(avg(v), 8) AS mean_theta, count(*) AS n_docs
    FROM copies JOIN m USING (docid) GROUP BY date, topic""",
)
def proportions_by_docid(spark, sf):
    rows = copies(spark, sf)
    out = drift.slice_proportions_by_docid(rows, rows, K)
    return out.withColumn("mean_theta", F.round("mean_theta", 8))


@query(
    "copy_divergence",
    "A26",
    f"""WITH {COPIES}, s AS (SELECT docid, topic, count(*) AS c, coalesce(stddev(v), 0) AS sd FROM clong GROUP BY docid, topic),
    w AS (SELECT docid, any_value(c) AS copies, max(sd) AS m FROM s GROUP BY docid)
    SELECT count(*) AS n_docids, count(*) FILTER (copies > 1) AS n_dup, round(avg(CASE WHEN copies > 1 THEN 1 ELSE 0 END), 6) AS dup_share,
    max(copies) AS max_copies, round(avg(m) FILTER (copies > 1), 6) AS mean_max_sd, round(max(m), 6) AS worst_max_sd FROM w""",
)
def copy_divergence(spark, sf):
    return stats.copy_divergence(copies(spark, sf), K)


DRIFT = """drifted AS (SELECT k, topic, min(mean_theta) AS min_theta, max(mean_theta) AS max_theta, avg(mean_theta) AS mean_theta,
  stddev_pop(mean_theta) AS std_theta, arg_min(mean_theta, date) AS first_theta, arg_max(mean_theta, date) AS last_theta,
  count(DISTINCT date) AS n_slices FROM {source} GROUP BY k, topic)"""
DRIFT_OUT = f"""SELECT k, topic, round(min_theta, 8) AS min_theta, round(max_theta, 8) AS max_theta, round(mean_theta, 8) AS mean_theta,
  round(std_theta, 8) AS std_theta, round(first_theta, 8) AS first_theta, round(last_theta, 8) AS last_theta, n_slices,
  round(max_theta - min_theta, 8) AS range_theta, {T.rounded('last_theta - first_theta', 8)} AS delta_first_last FROM drifted"""


def drift_out(rows: DataFrame) -> DataFrame:
    values = [c for c in rows.columns if c.endswith("_theta") or c == "delta_first_last"]
    return rows.select("k", "topic", "n_slices", *r(*values, digits=8))


@query("drift", "A14 T19 D12", f"WITH {PROPS}, {DRIFT.format(source='props')} {DRIFT_OUT}")
def topic_drift(spark, sf):
    return drift_out(drift.drift(proportions(spark, sf)))


@query(
    "heldout_union_drift",
    "T21 U4 A14",
    f"""WITH {PROPS}, {DRIFT.format(source='props')} {DRIFT_OUT}""",
)
def heldout_union_drift(spark, sf):
    """Train and held-out slices scored apart, stacked, then drift over all slices."""
    vectors = T.topics(spark, sf)
    train = drift.slice_proportions(vectors.where(F.col("date") < CHANGE), K)
    held = drift.slice_proportions(vectors.where(F.col("date") >= CHANGE), K)
    loose = held.withColumn("k", F.col("k").cast("string")).withColumn("n_docs", F.col("n_docs").cast("int"))
    return drift_out(drift.drift(drift.extend(train, loose)))


@query(
    "first_last_values",
    "W5",
    f"""WITH {PROPS} SELECT k, date, topic, round(first_value(mean_theta) OVER w, 8) AS first_theta,
    round(last_value(mean_theta) OVER w, 8) AS last_theta FROM props
    WINDOW w AS (PARTITION BY k, topic ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
)
def first_last_values(spark, sf):
    rows = drift.first_last_values(proportions(spark, sf))
    return rows.select("k", "date", "topic", *r("first_theta", "last_theta", digits=8))


RANKED = f"{PROPS}, ranked AS (SELECT *, rank() OVER (PARTITION BY k, date ORDER BY round(mean_theta, 12) DESC) AS rank FROM props)"


@query(
    "rank_stability",
    "W7",
    f"""WITH {RANKED} SELECT k, count(*) FILTER (inside = slices) AS core, count(*) FILTER (inside > 0) AS "union" FROM (
    SELECT k, topic, count(*) AS slices, count(*) FILTER (rank <= 20) AS inside FROM ranked GROUP BY k, topic) GROUP BY k""",
)
def rank_stability(spark, sf):
    return drift.rank_stability(proportions(spark, sf), 20)


@query(
    "rank_moves",
    "W7",
    f"""WITH {RANKED}, m AS (SELECT k, topic, arg_min(rank, date) AS f, arg_max(rank, date) AS l FROM ranked GROUP BY k, topic)
    SELECT k, topic, CAST(f AS INTEGER) AS first_rank, CAST(l AS INTEGER) AS last_rank, CAST(l - f AS INTEGER) AS change,
    CASE WHEN f <= 20 AND l > 20 THEN 'out' WHEN f > 20 AND l <= 20 THEN 'in' WHEN f <= 20 THEN 'stay' ELSE 'outside' END AS swap FROM m""",
)
def rank_moves(spark, sf):
    return drift.rank_moves(proportions(spark, sf), 20)


DETRENDED = f"""{PROPS}, det AS (SELECT *, mean_theta - baseline AS residual FROM (SELECT *, median(mean_theta) OVER (
  PARTITION BY k, topic ORDER BY date ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS baseline FROM props))"""


@query(
    "rolling_median",
    "W8",
    f"WITH {DETRENDED} SELECT k, date, topic, round(baseline, 8) AS baseline, {T.rounded('residual', 8)} AS residual FROM det",
)
def rolling_median(spark, sf):
    return drift.detrended(proportions(spark, sf)).select(
        "k", "date", "topic", *r("baseline", "residual", digits=8)
    )


@query(
    "seasonal_excursions",
    "W8",
    f"""WITH {DETRENDED}, x AS (SELECT k, topic, date, mean_theta, round(residual, 9) AS residual FROM det),
    p AS (SELECT k, topic, max(mean_theta) AS mx, avg(mean_theta) AS ty FROM x GROUP BY k, topic),
    b AS (SELECT k, topic, date, residual, row_number() OVER (PARTITION BY k, topic ORDER BY abs(residual) DESC, date DESC) AS r FROM x)
    SELECT k, topic, date AS peak_date, {T.rounded('residual', 9)} AS peak_residual, round(mx, 8) AS max_theta, round(ty, 8) AS typical_theta,
    round(abs(residual) / mx, 6) AS rel_excursion FROM b JOIN p USING (k, topic) WHERE r = 1""",
)
def seasonal_excursions(spark, sf):
    rows = drift.excursions(proportions(spark, sf))
    return rows.select(
        "k", "topic", "peak_date", *r("peak_residual", digits=9), *r("max_theta", "typical_theta", digits=8), *r("rel_excursion")
    )


# Twenty monthly slices, so that neighbouring years exist: documents' months.
YEARS = f"""{T.DOCS}, {T.THETAS},
dthetas AS (SELECT docs.date, theta FROM docs JOIN thetas ON docs.docid = thetas.docid),
dlong AS (SELECT date, generate_subscripts(theta, 1) - 1 AS topic, unnest(theta) AS v FROM dthetas),
props AS (SELECT {K} AS k, date, CAST(topic AS INTEGER) AS topic, avg(v) AS mean_theta, count(*) AS n_docs FROM dlong GROUP BY date, topic),
det AS (SELECT *, mean_theta - median(mean_theta) OVER (
  PARTITION BY k, topic ORDER BY date ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS residual,
  avg(mean_theta) OVER (PARTITION BY k, topic) AS typical FROM props)"""


@query(
    "co_spikes",
    "W9",
    f"""WITH {YEARS}, y AS (SELECT k, topic, substr(date, 6, 2) AS month, CAST(substr(date, 1, 4) AS INTEGER) AS year, residual, typical FROM det)
    SELECT a.k, a.topic, a.month, a.year, {T.rounded('a.residual', 8)} AS residual, {T.rounded('b.residual', 8)} AS next_residual,
    CASE WHEN sign(a.residual) = sign(b.residual) AND abs(a.residual) > 0.1 * a.typical AND abs(b.residual) > 0.1 * a.typical THEN 1 ELSE 0 END AS co_spike
    FROM y a JOIN y b ON a.k = b.k AND a.topic = b.topic AND a.month = b.month AND b.year = a.year + 1""",
)
def co_spikes(spark, sf):
    months = T.documents(spark, sf).select("docid", "date")
    vectors = T.topics(spark, sf).select("docid", "theta")
    rows = drift.co_spikes(drift.slice_proportions(months.join(vectors, "docid"), K))
    return rows.select("k", "topic", "month", "year", *r("residual", "next_residual", digits=8), "co_spike")


SHIFT = f"""{PROPS}, moved AS (SELECT *, post - pre AS delta FROM (SELECT k, topic, avg(mean_theta) FILTER (date < '{CHANGE}') AS pre,
  avg(mean_theta) FILTER (date >= '{CHANGE}') AS post FROM props GROUP BY k, topic))"""


@query(
    "mass_shift",
    "W11",
    f"WITH {SHIFT} SELECT k, round(sum(abs(delta)), 8) AS l1_shift, round(max(abs(delta)), 8) AS max_shift FROM moved GROUP BY k",
)
def mass_shift(spark, sf):
    return drift.mass_shift(proportions(spark, sf), CHANGE).select("k", *r("l1_shift", "max_shift", digits=8))


@query(
    "top_movers",
    "W11 W15",
    f"""WITH {SHIFT}, s AS (SELECT *, round(abs(delta), 9) AS size FROM moved)
    SELECT k, topic, {T.rounded('delta', 8)} AS delta, CAST(r AS INTEGER) AS r, round(running, 6) AS running_share FROM (
      SELECT *, row_number() OVER (PARTITION BY k ORDER BY size DESC, topic) AS r,
      sum(size) OVER (PARTITION BY k ORDER BY size DESC, topic ROWS UNBOUNDED PRECEDING) / sum(size) OVER (PARTITION BY k) AS running
      FROM s) WHERE r <= 15""",
)
def top_movers(spark, sf):
    rows = drift.top_movers(proportions(spark, sf), CHANGE)
    return rows.select("k", "topic", *r("delta", digits=8), "r", *r("running_share"))


@query(
    "plateau",
    "W15",
    f"""WITH {PROPS} SELECT k, round(max(std), 8) AS max_std, round(median(std / mean), 6) AS median_cv FROM (
    SELECT k, topic, stddev_pop(mean_theta) AS std, avg(mean_theta) AS mean FROM props
    WHERE date BETWEEN '2022-10' AND '2023-03' GROUP BY k, topic) GROUP BY k""",
)
def plateau(spark, sf):
    rows = drift.plateau(proportions(spark, sf), "2022-10", "2023-03")
    return rows.select("k", *r("max_std", digits=8), *r("median_cv"))


@query(
    "corpus_mass",
    "A36",
    f"WITH {PROPS} SELECT k, topic, round(sum(n_docs * mean_theta) / sum(n_docs), 8) AS mass FROM props GROUP BY k, topic",
)
def corpus_mass(spark, sf):
    return drift.corpus_mass(proportions(spark, sf)).select("k", "topic", *r("mass", digits=8))


@query("topic_mass", "T27", f"WITH {PROPS} SELECT CAST(topic AS INTEGER) AS topic, round(sum(v), 6) AS mass FROM long GROUP BY topic")
def topic_mass(spark, sf):
    return stats.topic_mass(T.topics(spark, sf), K).select("topic", *r("mass"))


# Dominant topic: the first of the largest values.
DOMINANT = f"""{T.THETAS}, dom AS (SELECT qid, label, CAST(list_position(theta, list_max(theta)) - 1 AS INTEGER) AS b FROM thetas)"""


def dominant(spark, sf) -> DataFrame:
    return T.topics(spark, sf).select("qid", F.col("label").alias("a"), V.dominant(F.col("theta")).alias("b"))


@query(
    "dominant_hist",
    "A24 T13",
    f"WITH {DOMINANT} SELECT b AS highest_topic, count(*) AS n, round(count(*) / (SELECT count(*) FROM dom), 6) AS share FROM dom GROUP BY b",
)
def dominant_hist(spark, sf):
    return stats.dominant_histogram(dominant(spark, sf).withColumnRenamed("b", "highest_topic"))


@query(
    "crosstab_purity",
    "A25 J12",
    f"""WITH {DOMINANT}, c AS (SELECT label AS a, b, count(*) AS n FROM dom GROUP BY label, b)
    SELECT a, b, n, round(n / sum(n) OVER (PARTITION BY a), 6) AS row_share,
    round(max(n) OVER (PARTITION BY b) / sum(n) OVER (PARTITION BY b), 6) AS column_purity FROM c""",
)
def crosstab_purity(spark, sf):
    first = T.topics(spark, sf).select("date", "docid", F.col("label").alias("a"))
    second = T.topics(spark, sf).select("date", "docid", V.dominant(F.col("theta")).alias("b"))
    return stats.crosstab(first.join(second, ["date", "docid"]))


@query(
    "topic_mix",
    "A27",
    f"""WITH {T.RUN}, {T.THETAS},
    mixes AS (SELECT 'corpus' AS side, theta FROM thetas
      UNION ALL SELECT 'query', theta FROM posed JOIN thetas USING (qid)
      UNION ALL SELECT 'retrieved', theta FROM run JOIN thetas USING (docid)),
    l AS (SELECT side, generate_subscripts(theta, 1) - 1 AS topic, unnest(theta) AS v FROM mixes),
    m AS (SELECT side, topic, avg(v) AS v, count(*) AS n_docs FROM l GROUP BY side, topic)
    SELECT side, CAST(topic AS INTEGER) AS topic, n_docs, round(v / sum(v) OVER (PARTITION BY side), 6) AS share FROM m""",
)
def topic_mix(spark, sf):
    vectors = T.topics(spark, sf)
    sides = [
        vectors.select(F.lit("corpus").alias("side"), "theta"),
        T.queries(spark, sf).join(vectors, "qid").select(F.lit("query").alias("side"), "theta"),
        T.run(spark, sf).select("docid").join(vectors, "docid").select(F.lit("retrieved").alias("side"), "theta"),
    ]
    rows = stats.topic_mix(clean.union_all(sides), ["side"], K)
    return rows.select("side", "topic", "n_docs", *r("share"))


@query(
    "query_topic_mix",
    "A31",
    f"""WITH {T.VISITS}, {T.THETAS}, inst AS (SELECT DISTINCT date, qid FROM visits),
    l AS (SELECT inst.date, generate_subscripts(theta, 1) - 1 AS topic, unnest(theta) AS v FROM inst JOIN thetas USING (qid)),
    m AS (SELECT date, topic, avg(v) AS v, count(*) AS n_docs FROM l GROUP BY date, topic)
    SELECT date, CAST(topic AS INTEGER) AS topic, n_docs, round(v / sum(v) OVER (PARTITION BY date), 6) AS share FROM m""",
)
def query_topic_mix(spark, sf):
    inst = T.visits(spark, sf).distinct()
    rows = stats.topic_mix(inst.join(T.topics(spark, sf).select("qid", "theta"), "qid"), ["date"], K)
    return rows.select("date", "topic", "n_docs", *r("share"))


@query(
    "wide_topics",
    "P11 D9",
    f"""WITH {T.THETAS} SELECT docid, {", ".join(f"round(theta[{i + 1}], 6) AS topic_{i}" for i in range(K))} FROM thetas""",
)
def wide_topics(spark, sf):
    """Array to wide columns and back."""
    wide = V.spread(T.topics(spark, sf).select("docid", "theta"), "theta", K)
    back = V.gather(wide, K)
    return back.select("docid", *[F.round(F.col("theta")[i], 6).alias(f"topic_{i}") for i in range(K)])


# --- topic models (no SQL form) -------------------------------------------------------

DOC = ["date", "docid"]


def phrased(spark, sf) -> DataFrame:
    """Stored phrased tokens: written once, read by every model of the application."""

    def build():
        rows = phrases.append_phrases(Q.stored_tokens(spark, sf), Q.stored_phrases(spark, sf), DOC)
        return written(rows.select("date", "docid", "language", "tokens_phrased"), "phrased")

    return T.once(spark, sf, "phrased", build)


def phrased_by_train(spark, sf) -> DataFrame:
    """Tokens of all slices with the phrases of the train slices."""

    def build():
        tokens = Q.stored_tokens(spark, sf)
        mined = Q.mined(tokens.where(F.col("date") <= T.LAST_TRAIN))
        rows = phrases.append_phrases(tokens, written(mined, "train-phrases"), DOC)
        return written(rows.select("date", "docid", "language", "tokens_phrased"), "train-phrased")

    return T.once(spark, sf, "train-phrased", build)


def features(spark, sf):
    def build():
        rows = phrased(spark, sf)
        vocabulary = topics.fit_vocabulary(rows, size=2000, min_df=3, max_df=0.5)
        return vocabulary, topics.vectorise(rows, vocabulary).select(*DOC, "features", "vocab_hits")

    return T.once(spark, sf, "features", build)


def lda(spark, sf, k: int):
    def build():
        return topics.fit_lda(features(spark, sf)[1], DOC, k, max_iter=5, subsampling_rate=0.3, learning_offset=64.0)

    return T.once(spark, sf, f"lda{k}", build)


@query(
    "vocabulary",
    "T9 T10",
    f"""WITH {Q.TOKENS}, {Q.UNIGRAMS}, {Q.BIGRAMS}, {Q.SCORED}, {Q.SCREENED},
    every AS (SELECT date, docid, unnest(tokens) AS term FROM toks
      UNION ALL SELECT date, docid, a || '_' || b FROM occ JOIN (SELECT a, b FROM kept) USING (a, b)),
    terms AS (SELECT term, count(*) AS n, count(DISTINCT (date, docid)) AS df FROM every GROUP BY term)
    SELECT CAST(row_number() OVER (ORDER BY n DESC, term) - 1 AS INTEGER) AS term_id, term FROM terms
    WHERE df >= 3 AND df <= 0.5 * (SELECT count(*) FROM toks) ORDER BY n DESC, term LIMIT 2000""",
)
def vocabulary(spark, sf):
    return topics.vocabulary_table(features(spark, sf)[0], spark)


@query("lda_theta", "T11 T13 J12")
def lda_theta(spark, sf):
    rows = topics.infer(lda(spark, sf, 4), features(spark, sf)[1], DOC)
    return V.spread(rows, "theta", 4)


@query("lda_topic_words", "T14 K8")
def lda_topic_words(spark, sf):
    words = topics.vocabulary_table(features(spark, sf)[0], spark)
    return topics.topic_words(lda(spark, sf, 4), words, 20)


@query("lda_sweep", "T12 T17 O5")
def lda_sweep(spark, sf):
    vocabulary, rows = features(spark, sf)
    words = topics.vocabulary_table(vocabulary, spark)
    fitted = topics.fit_sweep(rows, DOC, [2, 3, 4], max_iter=3, subsampling_rate=0.3, learning_offset=64.0)
    tables = [topics.topic_words(m, words, 10).withColumn("k", F.lit(k)) for k, m in fitted.items()]
    found = clean.union_all(tables).select("k", "topic", "pos", "word")
    return coherence.coherence_table(phrased(spark, sf), found).drop("per_topic_npmi", "top_words")


@query("heldout", "T20 T21")
def heldout(spark, sf):
    """Phrases, vocabulary and model of the train slices applied to the later ones, drift over all."""
    rows = phrased_by_train(spark, sf)
    train = rows.where(F.col("date") <= T.LAST_TRAIN)
    vocabulary = topics.fit_vocabulary(train, size=2000, min_df=3, max_df=0.5)
    every = topics.vectorise(rows, vocabulary)
    model = topics.fit_lda(
        every.where(F.col("date") <= T.LAST_TRAIN), DOC, 4, max_iter=3, subsampling_rate=0.3, learning_offset=64.0
    )
    theta = topics.infer(model, every, DOC)
    seen = drift.slice_proportions(theta.where(F.col("date") <= T.LAST_TRAIN), 4)
    new = drift.slice_proportions(theta.where(F.col("date") > T.LAST_TRAIN), 4)
    return drift.drift(drift.extend(seen, new))


@query("query_topics", "T23 D10")
def query_topics(spark, sf):
    """Topics of the queries in the documents' frozen feature space, phrases included."""
    from strata.functions import text as X

    tokens = X.content_tokens(X.simple_tokens("query"))
    asked = T.queries(spark, sf).select("qid", "query", tokens.alias("tokens"))
    asked = phrases.append_phrases(asked, Q.stored_phrases(spark, sf), ["qid"])
    known = topics.vectorise(asked, features(spark, sf)[0])
    return V.spread(topics.infer(lda(spark, sf, 4), known, ["qid"]), "theta", 4)


@query("conv_probe", "T22")
def conv_probe(spark, sf):
    return topics.probe_convergence(
        features(spark, sf)[1], DOC, k=4, iterations=[2, 4], offsets=[16.0, 64.0], holdout=0.25, subsampling_rate=0.3
    )


@query("lda_em_baseline", "T26 T27")
def lda_em_baseline(spark, sf):
    docs = T.documents(spark, sf).select(*DOC, "contents")
    fitted = topics.baseline_pipeline(3, max_iter=3, size=500, min_df=5.0).fit(docs)
    theta = fitted.transform(docs).select(vector_to_array("topicDistribution").alias("theta"))
    return stats.topic_mass(theta, 3)


@query("nmf", "T24")
def nmf(spark, sf):
    rows = phrased(spark, sf)
    stages = topics.fit_tfidf(rows, "tokens_phrased", size=2000, min_df=3)
    sparse = topics.sparse_rows(stages.transform(rows), DOC)
    h = topics.fit_nmf(sparse, k=5, n_terms=len(stages.stages[0].vocabulary), iterations=5, steps=10)
    return V.spread(topics.infer_nmf(sparse, DOC, h), "theta", 5)


@query("pca", "T25")
def pca(spark, sf):
    return topics.project_pca(T.topics(spark, sf), ["docid"])


@query("random_projection", "T25")
def random_projection(spark, sf):
    return topics.project_random(T.topics(spark, sf), ["docid"], K)


@query("embed", "M1 M2 D19")
def embed(spark, sf):
    docs = T.documents(spark, sf).select("docid", "date", "contents")
    rows = models.embed_shards(docs, models.hashing_model(16), shards=8, model_name="nomic-ai/test")
    return rows.select("docid", "date", "sample_id", "embedding")
