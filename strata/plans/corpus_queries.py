"""Corpus statistics, deduplication, sampling, joins and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.functions import keys as K
from strata.functions import text as X
from strata.operators import clean, ranking, sketches, stats
from strata.plans import tables as T
from strata.plans.registry import query
from strata.session import scratch_path, written
from strata.sources import readers

COUNTS = f"""{T.DOCS},
counts AS (SELECT date, split, language, docid, len({T.WORDS.format('contents')}) AS tokens,
                  len(string_split(contents, ' ')) AS words, length(contents) AS chars FROM docs)"""


MARKERS = ", ".join(f"'{w}'" for w in X.ENGLISH_MARKERS)


def counts(spark, sf):
    return stats.counted(T.documents(spark, sf))


@query(
    "corpus_stats",
    "A1 T28",
    f"""WITH {COUNTS} SELECT split, language, count(*) AS count, CAST(sum(tokens) AS BIGINT) AS sum_tokens,
    round(avg(tokens), 6) AS avg_tokens, round(stddev(tokens), 6) AS stddev_tokens,
    round(avg(words), 6) AS avg_words, round(stddev(words), 6) AS stddev_words FROM counts GROUP BY split, language""",
)
def corpus_stats(spark, sf):
    return stats.length_summary(counts(spark, sf), ["split", "language"])


@query(
    "token_stats_sets",
    "A2",
    f"""WITH {COUNTS} SELECT split, language, date, CAST(sum(tokens) AS BIGINT) AS sum_tokens,
    CAST(sum(words) AS BIGINT) AS sum_words, CAST(sum(tokens) AS BIGINT) / 1e6 AS sum_tokens_pm,
    CAST(sum(words) AS BIGINT) / 1e6 AS sum_words_pm
    FROM counts GROUP BY GROUPING SETS ((split, language, date), (split, language))""",
)
def token_stats_sets(spark, sf):
    return stats.length_sets(counts(spark, sf))


@query(
    "slice_counts",
    "A3 P1",
    f"WITH {T.DOCS} SELECT split, date, count(*) AS n FROM docs GROUP BY split, date",
)
def slice_counts(spark, sf):
    return stats.rows_per(clean.slice_filter(T.documents(spark, sf), "all"), ["split", "date"])


@query(
    "slice_filter",
    "P1 P3",
    f"""WITH {T.DOCS} SELECT language, count(*) AS n, CAST(sum(length(contents)) AS BIGINT) AS chars
    FROM docs WHERE date = '2023-01' AND length(contents) > 50 GROUP BY language""",
)
def slice_filter(spark, sf):
    kept = clean.longer_than(clean.slice_filter(T.documents(spark, sf), "2023-01"))
    return kept.groupBy("language").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("contents")).alias("chars")
    )


# --- deduplication -------------------------------------------------------------


@query(
    "dedup_longest",
    "W1 P3",
    f"""WITH {T.RECORDS} SELECT docid, date, turn, sha256(contents) AS hash FROM (
    SELECT *, row_number() OVER (PARTITION BY docid ORDER BY length(contents) DESC, sha256(contents)) AS r
    FROM records WHERE length(contents) > 50) WHERE r = 1""",
)
def dedup_longest(spark, sf):
    kept = clean.keep_longest(T.records(spark, sf), ["docid"])
    return kept.select("docid", "date", "turn", F.sha2("contents", 256).alias("hash"))


@query(
    "dedup_longest_in_slice",
    "W2",
    f"""WITH {T.RECORDS} SELECT docid, date, turn, sha256(contents) AS hash FROM (
    SELECT *, row_number() OVER (PARTITION BY date, docid ORDER BY length(contents) DESC, sha256(contents)) AS r
    FROM records WHERE length(contents) > 50) WHERE r = 1""",
)
def dedup_longest_in_slice(spark, sf):
    kept = clean.keep_longest(T.records(spark, sf), ["date", "docid"])
    return kept.select("docid", "date", "turn", F.sha2("contents", 256).alias("hash"))


@query(
    "dedup_sha",
    "W3 U6",
    f"""WITH {T.RECORDS} SELECT docid, date, min(sha256(contents)) AS hash FROM records GROUP BY docid, date""",
)
def dedup_sha(spark, sf):
    kept = clean.keep_smallest_hash(T.records(spark, sf).drop("turn"), ["date", "docid"])
    return kept.select("docid", "date", F.sha2("contents", 256).alias("hash"))


@query(
    "dedup_copies",
    "W3 U6",
    f"""WITH {T.DOCS} SELECT date, md5(contents) AS copy_of, min(docid) AS docid, count(*) AS copies
    FROM docs GROUP BY date, md5(contents)""",
)
def dedup_copies(spark, sf):
    rows = T.documents(spark, sf).select("date", F.md5("contents").alias("copy_of"), "docid")
    return rows.groupBy("date", "copy_of").agg(
        F.min("docid").alias("docid"), F.count(F.lit(1)).alias("copies")
    )


MULTIPLICITY = f"""{T.DOCS},
hist AS (SELECT split, date, copies, count(*) AS n_keys FROM (
    SELECT split, date, md5(contents) AS h, count(*) AS copies FROM docs GROUP BY split, date, md5(contents))
    GROUP BY split, date, copies)"""


def hashed(spark, sf):
    return T.documents(spark, sf).select("split", "date", F.md5("contents").alias("h"))


@query("dup_hist", "A4", f"WITH {MULTIPLICITY} SELECT * FROM hist")
def dup_hist(spark, sf):
    return stats.multiplicity(hashed(spark, sf), ["h"], ["split", "date"])


@query(
    "dup_pivot",
    "A5",
    f"""WITH {MULTIPLICITY} SELECT copies, round(avg(n_keys) FILTER (split = 'train'), 6) AS train,
    round(avg(n_keys) FILTER (split = 'test'), 6) AS test FROM hist GROUP BY copies""",
)
def dup_pivot(spark, sf):
    return stats.multiplicity_by_split(hashed(spark, sf), ["h"])


@query(
    "copy_consistency",
    "A35",
    f"""WITH {T.RECORDS} SELECT docid, count(*) AS copies, count(DISTINCT sha256(contents)) AS texts,
    min(length(contents)) AS min_chars, max(length(contents)) AS max_chars
    FROM records GROUP BY docid HAVING count(*) > 1""",
)
def copy_consistency(spark, sf):
    return stats.copy_consistency(T.records(spark, sf), ["docid"])


@query(
    "boilerplate_top",
    "A22",
    f"""WITH {T.DOCS} SELECT split, hash, n, r FROM (
    SELECT split, hash, n, row_number() OVER (PARTITION BY split ORDER BY n DESC, hash) AS r FROM (
      SELECT split, sha256(contents) AS hash, count(*) AS n FROM docs GROUP BY split, sha256(contents))
      WHERE n >= 2) WHERE r <= 20""",
)
def boilerplate_top(spark, sf):
    return stats.top_texts(T.documents(spark, sf), ["split"], n=20, at_least=2)


@query(
    "content_uniqueness",
    "A20",
    f"""WITH {T.DOCS} SELECT date, count(*) AS n_docs, count(DISTINCT sha256(contents)) AS n_unique,
    round(count(DISTINCT sha256(contents)) / count(*), 6) AS unique_frac FROM docs GROUP BY date""",
)
def content_uniqueness(spark, sf):
    return stats.exact_uniqueness(T.documents(spark, sf), ["date"])


@query("content_uniqueness_approx", "A20")
def content_uniqueness_approx(spark, sf):
    return stats.uniqueness(T.documents(spark, sf), ["date"])


def _quantiles_sql(column: str) -> str:
    names = ", ".join(
        f"round(quantile_cont({column}, {q}), 6) AS {n}" for n, q in stats.QUANTILES.items()
    )
    return f"WITH {COUNTS} SELECT date, count(*) AS n_docs, {names} FROM counts GROUP BY date"


@query("length_quantiles_chars", "A19", _quantiles_sql("chars"))
def length_quantiles_chars(spark, sf):
    return stats.exact_length_quantiles(counts(spark, sf), ["date"], "chars")


@query("length_quantiles_words", "A19", _quantiles_sql("words"))
def length_quantiles_words(spark, sf):
    return stats.exact_length_quantiles(counts(spark, sf), ["date"], "words")


@query("length_quantiles_approx", "A19")
def length_quantiles_approx(spark, sf):
    return stats.length_quantiles(counts(spark, sf), ["date"], "chars")


@query(
    "en_density",
    "A21",
    rf"""WITH {T.DOCS}, dens AS (
    SELECT date, round(len(list_filter(regexp_extract_all(lower(contents), '[\p{{L}}\p{{N}}_]+'), lambda w: w IN ({MARKERS})))
           / len(list_filter(regexp_split_to_array(contents, '\s+'), lambda w: w <> '')), 9) AS d FROM docs)
    SELECT date, count(*) AS n_docs, round(avg(d), 6) AS density_mean, round(quantile_cont(d, 0.5), 6) AS density_p50,
    round(quantile_cont(d, 0.95), 6) AS density_p95, round(avg(CASE WHEN d > 0.05 THEN 1 ELSE 0 END), 6) AS frac_above_05,
    round(avg(CASE WHEN d > 0.10 THEN 1 ELSE 0 END), 6) AS frac_above_10 FROM dens GROUP BY date""",
)
def en_density(spark, sf):
    return stats.english_density(T.documents(spark, sf), ["date"])


@query(
    "fused_diagnostics",
    "A2 A18 A21",
    rf"""WITH {T.DOCS}, thin AS (
    SELECT date, length(contents) AS chars, sha256(contents) AS h,
           round(len(list_filter(regexp_extract_all(lower(contents), '[\p{{L}}\p{{N}}_]+'), lambda w: w IN ({MARKERS})))
           / len(list_filter(regexp_split_to_array(contents, '\s+'), lambda w: w <> '')), 9) AS d FROM docs)
    SELECT date, count(*) AS n_docs, round(avg(chars), 6) AS mean_chars, max(chars) AS max_chars, round(avg(d), 6) AS density_mean,
    round(avg(CASE WHEN d > 0.05 THEN 1 ELSE 0 END), 6) AS frac_above_05, count(DISTINCT h) AS n_unique,
    quantile_cont(chars, 0.5) AS median_chars, round(quantile_cont(d, 0.5), 6) AS density_p50 FROM thin GROUP BY date""",
)
def fused_diagnostics(spark, sf):
    """Lengths, uniqueness and English density from one pass over the texts."""
    thin = written(stats.thin_rows(T.documents(spark, sf), ["date"]), "thin")
    return stats.diagnostics(thin, ["date"]).withColumn("density_p50", F.round("density_p50", 6))


# --- samples, shards, unions -------------------------------------------------------


@query(
    "hash_shard",
    "P7 M3",
    f"""WITH {T.DOCS} SELECT split, CAST(concat('0x', substr(md5(docid), 1, 7)) AS BIGINT) % 16 AS sample_id,
    count(*) AS n, CAST(sum(length(contents)) AS BIGINT) AS chars FROM docs GROUP BY 1, 2""",
)
def hash_shard(spark, sf):
    rows = T.documents(spark, sf).withColumn("sample_id", K.md5_shard("docid", 16).cast("bigint"))
    return rows.groupBy("split", "sample_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("contents")).alias("chars")
    )


@query(
    "crc_shard",
    "P7",
    f"WITH {T.DOCS} SELECT ({T.crc32_sql('docid')} % 16)::INTEGER AS sample_id, count(*) AS n FROM docs GROUP BY sample_id",
)
def crc_shard(spark, sf):
    return stats.rows_per(clean.shard(T.documents(spark, sf), "docid", 16), ["sample_id"])


@query(
    "hash_sample",
    "P6 P8",
    f"""WITH {T.DOCS} SELECT CASE WHEN {T.unit_hash_sql(42, 'date', 'docid')} < 0.25 THEN 'holdout' ELSE 'train' END AS side, date,
    count(*) AS n FROM docs GROUP BY side, date""",
)
def hash_sample(spark, sf):
    train, held = clean.holdout_split(T.documents(spark, sf), ["date", "docid"], 0.25)
    sides = clean.union_all([train.withColumn("side", F.lit("train")), held.withColumn("side", F.lit("holdout"))])
    return stats.rows_per(sides, ["side", "date"])


@query(
    "draw_queries",
    "P9",
    f"""WITH {T.LOG}, drawn AS (SELECT DISTINCT qid FROM log ORDER BY md5(concat_ws(chr(31), '42', qid)), qid LIMIT 20)
    SELECT qid, count(*) AS n FROM log WHERE qid IN (SELECT qid FROM drawn) GROUP BY qid""",
)
def draw_queries(spark, sf):
    return clean.draw_queries(T.query_log(spark, sf), n=20, seed=42).groupBy("qid").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "split_union",
    "U1 U2 U3",
    f"""WITH {T.DOCS} SELECT split, count(*) AS n, count(note) AS noted FROM (
    SELECT split, NULL AS note FROM docs WHERE split = 'train'
    UNION ALL SELECT split, language AS note FROM docs WHERE split = 'test') GROUP BY split""",
)
def split_union(spark, sf):
    docs = T.documents(spark, sf)
    train = docs.where(F.col("split") == "train").select("split", "docid")
    test = docs.where(F.col("split") == "test").select("docid", "split", F.col("language").alias("note"))
    both = clean.union_all([train, test], allow_missing=True)
    return both.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count("note").alias("noted"))


@query(
    "aligned_union",
    "U4",
    """SELECT kind, count(*) AS n, round(sum(amount), 2) AS amount FROM (
    SELECT event_type AS kind, value AS amount FROM events
    UNION ALL SELECT l_returnflag AS kind, CAST(l_linenumber AS DOUBLE) AS amount FROM lineitem) GROUP BY kind""",
)
def aligned_union(spark, sf):
    first = T.table(spark, sf, "events").select(F.col("event_type").alias("kind"), F.col("value").alias("amount"))
    other = T.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("kind"), F.col("l_linenumber").alias("amount")
    )
    return clean.union_as(first, other).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("amount"), 2).alias("amount")
    )


@query(
    "set_sizes",
    "U7 U6",
    """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'),
    b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O')
    SELECT (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) AS "both",
    (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) AS left_only,
    (SELECT count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a)) AS right_only,
    (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)) AS either""",
)
def set_sizes(spark, sf):
    orders = T.table(spark, sf, "orders")
    return clean.set_sizes(
        orders.where(F.col("o_orderstatus") == "F"), orders.where(F.col("o_orderstatus") == "O"), "o_custkey"
    )


@query(
    "docid_forms",
    "P4 P5",
    f"""WITH {T.DOCS}, {T.RECORDS} SELECT regexp_replace(docid, '^doc([0-9])', '\\1') AS bare,
    TRY_CAST(replace(docid, 'doc', '') AS BIGINT) AS number, count(*) AS n
    FROM (SELECT docid FROM docs UNION ALL SELECT date || docid AS docid FROM records) GROUP BY 1, 2""",
)
def docid_forms(spark, sf):
    names = T.records(spark, sf).select(F.concat("date", "docid").alias("docid"))
    both = T.documents(spark, sf).select("docid").unionByName(names)
    return both.groupBy(X.bare_docid("docid").alias("bare"), X.numeric_docid("docid").alias("number")).agg(
        F.count(F.lit(1)).alias("n")
    )


# --- query sets ------------------------------------------------------------------------


@query(
    "recurrence_hist",
    "A16",
    f"""WITH {T.VISITS}, months AS (SELECT qid, count(DISTINCT date) AS n_months FROM visits GROUP BY qid)
    SELECT n_months, count(*) AS n_qids, round(count(*) / (SELECT count(*) FROM months), 6) AS share
    FROM months GROUP BY n_months""",
)
def recurrence_hist(spark, sf):
    return stats.recurrence(T.visits(spark, sf))


@query(
    "query_churn",
    "W10 U7",
    f"""WITH {T.VISITS}, inst AS (SELECT DISTINCT date, qid FROM visits),
    steps AS (SELECT date AS from_date, lead(date) OVER (ORDER BY date) AS to_date, n AS n_from,
                     lead(n) OVER (ORDER BY date) AS n_to FROM (SELECT date, count(*) AS n FROM inst GROUP BY date)),
    shared AS (SELECT s.to_date, count(*) AS c FROM steps s JOIN inst a ON a.date = s.from_date
               JOIN inst b ON b.date = s.to_date AND b.qid = a.qid GROUP BY s.to_date)
    SELECT from_date, to_date, n_from, n_to, coalesce(c, 0) AS n_both,
           round(coalesce(c, 0) / (n_from + n_to - coalesce(c, 0)), 6) AS jaccard,
           round((n_to - coalesce(c, 0)) / n_to, 6) AS new_share
    FROM steps LEFT JOIN shared USING (to_date) WHERE to_date IS NOT NULL""",
)
def query_churn(spark, sf):
    return stats.churn(T.visits(spark, sf))


LENGTHS = rf"""{T.LOG}, lengths AS (
    SELECT date, qid, CAST(len(list_filter(regexp_split_to_array(query, '\s+'), lambda w: w <> '')) AS BIGINT) AS words,
    CAST(len({T.WORDS.format('query')}) AS BIGINT) AS tokens, CAST(length(query) AS BIGINT) AS chars FROM log)"""
SCOPE = """count(*) AS n, round(avg(words), 6) AS avg_words, quantile_cont(words, 0.5) AS med_words,
    round(stddev_pop(words), 6) AS std_words, round(avg(tokens), 6) AS avg_tokens,
    round(avg(chars), 6) AS avg_chars, max(words) AS max_words"""


@query(
    "query_stats",
    "A18 A15",
    f"""WITH {LENGTHS} SELECT date AS scope, {SCOPE} FROM lengths GROUP BY date
    UNION ALL SELECT 'pooled' AS scope, {SCOPE} FROM lengths
    UNION ALL SELECT 'unique' AS scope, {SCOPE} FROM (
      SELECT qid, arg_min(words, date) AS words, arg_min(tokens, date) AS tokens, arg_min(chars, date) AS chars
      FROM lengths GROUP BY qid)""",
)
def query_stats(spark, sf):
    return stats.query_stats(T.query_log(spark, sf))


@query(
    "word_count_distribution",
    "A18 P2",
    f"WITH {LENGTHS} SELECT words, count(*) AS n FROM lengths GROUP BY words",
)
def word_count_distribution(spark, sf):
    return stats.word_count_distribution(clean.with_query(T.query_log(spark, sf)))


@query("oversize_queries", "P13", f"WITH {LENGTHS} SELECT date, qid, words FROM lengths WHERE words > 50")
def oversize_queries(spark, sf):
    return clean.oversize(T.query_log(spark, sf)).select("date", "qid", F.col("words").cast("bigint").alias("words"))


@query(
    "first_text",
    "A15",
    f"WITH {T.LOG} SELECT qid, arg_min(md5(query), date) AS text_hash FROM log GROUP BY qid",
)
def first_text(spark, sf):
    return clean.first_text(T.query_log(spark, sf)).select("qid", F.md5("query").alias("text_hash"))


@query(
    "identifier_stability",
    "A33",
    f"""WITH {T.LOG} SELECT count(*) AS n_qids, count(*) FILTER (texts > 1) AS n_mismatched,
    count(*) FILTER (tr AND te) AS n_shared FROM (
      SELECT qid, count(DISTINCT query) AS texts, bool_or(split = 'train') AS tr, bool_or(split = 'test') AS te
      FROM log GROUP BY qid)""",
)
def identifier_stability(spark, sf):
    return stats.identifier_stability(T.query_log(spark, sf))


@query(
    "query_multiplicity",
    "A34",
    f"""WITH {T.VISITS} SELECT copies, count(*) AS n_keys FROM (
    SELECT qid, count(*) AS copies FROM visits GROUP BY qid) GROUP BY copies""",
)
def query_multiplicity(spark, sf):
    return stats.multiplicity(T.visits(spark, sf), ["qid"], [])


@query(
    "expansion_coverage",
    "A32",
    rf"""WITH {T.WHOLE}, e AS (SELECT qid AS conv_id, text FROM whole),
    w AS (SELECT len(list_filter(regexp_split_to_array(b.text, '\s+'), lambda x: x <> '')) AS q,
          len(list_filter(regexp_split_to_array(e.text, '\s+'), lambda x: x <> '')) AS e
          FROM benchmark b LEFT JOIN e ON e.conv_id = CAST(b.item_id AS VARCHAR))
    SELECT count(e) AS n_expanded, count(*) FILTER (e IS NULL) AS n_uncovered,
    round(avg(q) FILTER (e IS NOT NULL), 6) AS avg_query_words, round(avg(e), 6) AS avg_expanded_words,
    max(e) AS max_expanded_words FROM w""",
)
def expansion_coverage(spark, sf):
    return stats.expansion_coverage(T.queries(spark, sf), T.whole_conversations(spark, sf))


# --- describe, ordered lists, nested fields -----------------------------------------


@query(
    "describe_values",
    "A9",
    """SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev(value), 6) AS std,
    min(value) AS min, quantile_cont(value, 0.5) AS p50, max(value) AS max FROM events GROUP BY event_type""",
)
def describe_values(spark, sf):
    rows = T.table(spark, sf, "events")
    moments = rows.groupBy("event_type").agg(
        F.count("value").alias("n"),
        F.round(F.avg("value"), 6).alias("mean"),
        F.round(F.stddev("value"), 6).alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    return moments.join(stats.medians(rows, ["event_type"], "value", "p50"), "event_type")


@query(
    "summary_table",
    "A9",
    """SELECT unnest(['count', 'mean', 'stddev', 'min', 'max']) AS summary,
    unnest([n, round(m, 6), round(s, 6), lo, hi]) AS value FROM (
      SELECT count(value)::DOUBLE AS n, avg(value) AS m, stddev(value) AS s, min(value)::DOUBLE AS lo, max(value)::DOUBLE AS hi FROM events)""",
)
def summary_table(spark, sf):
    """The five exact rows of the summary; its percentiles are approximate."""
    rows = T.table(spark, sf, "events").select("value").summary("count", "mean", "stddev", "min", "max")
    return rows.select("summary", F.round(F.col("value").cast("double"), 6).alias("value"))


@query(
    "summary_percentiles",
    "A9",
    """SELECT unnest(['25%', '50%', '75%']) AS summary,
    round(unnest(quantile_disc(value, [0.25, 0.5, 0.75])), 6)::DOUBLE AS value FROM events""",
)
def summary_percentiles(spark, sf):
    """The percentile rows of the summary, exact."""
    rows = stats.quantiles(T.table(spark, sf, "events"), "value", [0.25, 0.5, 0.75])
    return rows.select(
        F.concat((F.col("share") * 100).cast("int").cast("string"), F.lit("%")).alias("summary"),
        F.round("value", 6).alias("value"),
    )


@query(
    "ordered_lists",
    "A17 W6",
    """SELECT user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, value,
    row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS pos FROM events""",
)
def ordered_lists(spark, sf):
    rows = T.table(spark, sf, "events")
    placed = ranking.positions(
        rows, ["user_id", "event_type"], F.date_trunc("hour", "ts"), [F.asc("ts"), F.asc("event_id")]
    )
    return placed.select(
        "user_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "value", "pos"
    )


@query(
    "json_events",
    "S17 P14 D20",
    """SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n,
    round(sum(value), 4) AS value FROM events GROUP BY 1, 2""",
)
def json_events(spark, sf):
    parsed = T.table(spark, sf, "events").select(
        "event_type", "value", F.from_json("props", "k bigint").alias("p")
    )
    flat = clean.flatten(parsed, "p")
    return flat.groupBy("event_type", "k").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value")
    )


def _text_sketches(spark, sf):
    """Stored sketches of the slices' texts; half of the documents arrive later."""
    path = scratch_path(spark, "sketches")
    docs = T.documents(spark, sf)
    for half in (0, 1):
        part = docs.where(F.crc32("docid") % 2 == half)
        sketches.add_slices(part, path, ["date"], F.sha2("contents", 256), F.length("contents"))
    return sketches.merged(sketches.read(spark, path), ["date"])


@query(
    "sketch_quantiles",
    "A19 A20",
    f"""WITH {T.DOCS} SELECT date, count(*) AS n, count(DISTINCT contents) AS n_distinct,
    quantile_disc(length(contents), 0.05)::BIGINT AS p05, quantile_disc(length(contents), 0.5)::BIGINT AS p50,
    quantile_disc(length(contents), 0.95)::BIGINT AS p95 FROM docs GROUP BY date""",
)
def sketch_quantiles(spark, sf):
    """Exact for slices of up to 200 documents, then within the bounds of the sketches."""
    return sketches.quantiles(_text_sketches(spark, sf), ["date"], [0.05, 0.5, 0.95])


@query(
    "sketch_overlap",
    "W10 A20",
    f"""WITH {T.LOG}, dates AS (SELECT date, lead(date) OVER (ORDER BY date) AS next FROM (SELECT DISTINCT date FROM log)),
    sides AS (SELECT d.date, d.next, l.qid, l.date = d.date AS own FROM dates d JOIN log l ON l.date IN (d.date, d.next)),
    keys AS (SELECT date, next, qid, bool_or(own) AS a, bool_or(NOT own) AS b FROM sides WHERE next IS NOT NULL GROUP BY ALL)
    SELECT date, next, count(*) FILTER (a AND b) AS n_both, count(*) AS n_either, round(count(*) FILTER (a AND b) / count(*), 6) AS jaccard
    FROM keys GROUP BY date, next""",
)
def sketch_overlap(spark, sf):
    """Queries that neighbouring slices share, from stored sketches; exact for up to 4096 queries."""
    path = scratch_path(spark, "query-sketches")
    sketches.add_slices(T.query_log(spark, sf), path, ["date"], F.col("qid"), F.length("query"))
    return sketches.overlaps(sketches.merged(sketches.read(spark, path), ["date"]), "date")


@query(
    "event_log",
    "S17 P14 D20",
    """SELECT event_type AS product_name, count(*) AS n_events, count(user_id) AS n_processes,
    round(max(s - s0) / 60.0, 6) AS last_minute, round(avg(s - s0) / 60.0, 4) AS mean_minute
    FROM (SELECT event_type, user_id, floor(epoch(ts))::BIGINT AS s, min(floor(epoch(ts))::BIGINT) OVER (PARTITION BY event_type) AS s0 FROM events)
    GROUP BY event_type""",
)
def event_log(spark, sf):
    """A nested monitoring log: its processes, and minutes since a product's first event."""
    path = scratch_path(spark, "event-log")
    process = F.struct(F.col("user_id").cast("string").alias("pid"), F.lit("job").alias("process_name"))
    gpu = F.struct(
        F.col("event_type").alias("product_name"),
        F.struct(F.col("value").cast("string").alias("gpu_util")).alias("utilization"),
        F.struct(F.array(process).alias("process_info")).alias("processes"),
    )
    log = F.struct(F.date_format("ts", "EEE MMM d HH:mm:ss yyyy").alias("timestamp"), gpu.alias("gpu"))
    T.table(spark, sf, "events").select(F.to_json(F.struct(log.alias("nvidia_smi_log")))).write.text(path)
    events = stats.elapsed_minutes(readers.gpu_log(spark, path), ["product_name"], "timestamp")
    rows = clean.explode_records(events, "process_info")
    return rows.groupBy("product_name").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count("pid").alias("n_processes"),
        F.round(F.max("minutes"), 6).alias("last_minute"),
        F.round(F.avg("minutes"), 4).alias("mean_minute"),
    )


@query(
    "longest_documents",
    "O4",
    f"""WITH {T.DOCS} SELECT docid, date, length(contents) AS chars FROM docs ORDER BY length(contents) DESC, docid LIMIT 25""",
)
def longest_documents(spark, sf):
    rows = T.documents(spark, sf).select("docid", "date", F.length("contents").cast("bigint").alias("chars"))
    return rows.orderBy(F.desc("chars"), "docid").limit(25)
