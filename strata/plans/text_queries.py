"""Tokenizing, phrase mining, vocabulary and coherence queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.functions import text as X
from strata.functions.words import ELISIONS, ENGLISH_STOPWORDS, FRENCH_STOPWORDS
from strata.operators import coherence, phrases
from strata.operators.ranking import top_k, unnest
from strata.plans import tables as T
from strata.plans.registry import query
from strata.session import written

MIN_COUNT = 5
THRESHOLD = 0.3
CEILING = 0.6
PERCENTILE = 99.0

ALL_STOP = ", ".join(
    "'" + w.replace("'", "''") + "'" for w in sorted(set(FRENCH_STOPWORDS) | set(ENGLISH_STOPWORDS))
)

TOKENS = f"""{T.DOCS},
toks AS (SELECT date, docid, language, split, list_filter({T.WORDS.format('contents')},
  lambda t: t NOT IN ({ALL_STOP}) AND length(t) >= 3 AND NOT regexp_full_match(t, '[0-9]+')) AS tokens FROM docs)"""

UNIGRAMS = """uni AS (SELECT w, count(*) AS w_count FROM (SELECT unnest(tokens) AS w FROM toks) GROUP BY w)"""

BIGRAMS = """occ AS (SELECT date, docid, i, tokens[i] AS a, tokens[i + 1] AS b
  FROM (SELECT date, docid, tokens, unnest(range(1, greatest(len(tokens), 1))) AS i FROM toks)),
big AS (SELECT a, b, count(*) AS count FROM occ GROUP BY a, b)"""

SCORED = f"""tot AS (SELECT CAST(sum(w_count) AS DOUBLE) AS t FROM uni),
scored AS (SELECT * FROM (
  SELECT a, b, ln((count / t) / ((ua.w_count / t) * (ub.w_count / t))) / -ln(count / t) AS npmi, count
  FROM big JOIN uni ua ON ua.w = a JOIN uni ub ON ub.w = b, tot
  WHERE count >= {MIN_COUNT} AND ua.w_count >= {MIN_COUNT} AND ub.w_count >= {MIN_COUNT}) WHERE npmi >= {THRESHOLD})"""

SCREENED = f"""cut AS (SELECT quantile_disc(count, {PERCENTILE / 100}) AS c FROM scored WHERE npmi >= {CEILING}),
kept AS (SELECT a, b, npmi, count FROM scored, cut WHERE NOT (npmi >= {CEILING} AND count >= coalesce(c, 9e18)))"""


def tokens(spark, sf) -> DataFrame:
    return T.documents(spark, sf).select(
        "date", "docid", "language", "split", X.content_tokens(X.simple_tokens("contents")).alias("tokens")
    )


def stored_tokens(spark, sf) -> DataFrame:
    """The tokens written once: what reads them more than once does not tokenize again."""
    return T.once(spark, sf, "tokens", lambda: written(tokens(spark, sf), "tokens"))


def mined(rows: DataFrame) -> DataFrame:
    return phrases.mine(
        rows, min_count=MIN_COUNT, threshold=THRESHOLD, ceiling=CEILING, percentile=PERCENTILE
    )


def stored_phrases(spark, sf) -> DataFrame:
    return T.once(spark, sf, "phrases", lambda: written(mined(stored_tokens(spark, sf)), "phrases"))


@query(
    "tokenize",
    "T1 T2 T3",
    f"""WITH {TOKENS} SELECT date, docid, len(tokens) AS n, md5(array_to_string(tokens, ' ')) AS tokens_hash FROM toks""",
)
def tokenize(spark, sf):
    return tokens(spark, sf).select(
        "date",
        "docid",
        F.size("tokens").cast("bigint").alias("n"),
        F.md5(F.array_join("tokens", " ")).alias("tokens_hash"),
    )


def _plural_sql(t: str) -> str:
    return f"""CASE WHEN length({t}) > 5 THEN regexp_replace(regexp_replace({t}, '([^e])aux$', '\\1al'), '[xs]$', '')
      WHEN length({t}) > 3 THEN regexp_replace({t}, '[xs]$', '') ELSE {t} END"""


def _ending_sql(t: str) -> str:
    cases = " ".join(
        f"WHEN length({t}) >= {n} AND suffix({t}, '{e}') THEN substr({t}, 1, length({t}) - {len(e)}) || '{r}'"
        for n, e, r in X.LIGHT_ENDINGS
    )
    return f"CASE {cases} ELSE {t} END"


def _folded_sql(t: str) -> str:
    folded = f"translate({t}, '{X.FOLD_FROM}', '{X.FOLD_TO}')"
    for letter in "abcdefghijklmnopqrstuvwxyzßäöüñáíóúœæ":
        folded = f"replace({folded}, '{letter * 2}', '{letter}')"
    return f"""CASE WHEN length({t}) <= 4 THEN {t}
      WHEN regexp_matches({folded}, '^.{{3}}.*ie$') THEN regexp_replace({folded}, 'ie$', '')
      ELSE regexp_replace({folded}, '^(.{{4}}.*?)e{{0,2}}r?$', '\\1') END"""


ENDINGS = rf"""{T.DOCS},
raw AS (SELECT date, docid, regexp_extract_all(lower(contents), '[\p{{L}}\p{{N}}]+(?:[''’][\p{{L}}\p{{N}}]+)*') AS t FROM docs),
elided AS (SELECT date, docid, list_filter(list_transform(t,
  lambda x: regexp_replace(x, '^(?:{"|".join(ELISIONS)})[''’]', '')), lambda x: x NOT IN ({T.STOP})) AS t FROM raw),
ended AS (SELECT date, docid, list_transform(list_transform(t, lambda x: {_plural_sql('x')}), lambda x: {_ending_sql('x')}) AS t FROM elided)"""


@query(
    "analyze_french",
    "T1 X1",
    f"""WITH {ENDINGS}, folded AS (SELECT date, docid, list_transform(t, lambda x: {_folded_sql('x')}) AS t FROM ended)
    SELECT date, docid, len(t) AS n, md5(array_to_string(t, ' ')) AS tokens_hash FROM folded""",
)
def analyze_french(spark, sf):
    rows = T.documents(spark, sf).select("date", "docid", X.french_tokens("contents").alias("tokens"))
    return rows.select(
        "date",
        "docid",
        F.size("tokens").cast("bigint").alias("n"),
        F.md5(F.array_join("tokens", " ")).alias("tokens_hash"),
    )


@query(
    "french_endings",
    "T1",
    f"WITH {ENDINGS} SELECT stem, count(*) AS n FROM (SELECT unnest(t) AS stem FROM ended) GROUP BY stem",
)
def french_endings(spark, sf):
    """Counts of French stems before folding."""
    stems = T.documents(spark, sf).select(F.explode(X.french_endings("contents")).alias("stem"))
    return stems.groupBy("stem").agg(F.count(F.lit(1)).alias("n"))


@query("unigrams", "T4", f"WITH {TOKENS}, {UNIGRAMS} SELECT * FROM uni")
def unigrams(spark, sf):
    return phrases.unigram_counts(tokens(spark, sf))


@query("bigrams", "T5", f"WITH {TOKENS}, {BIGRAMS} SELECT * FROM big WHERE count >= 2")
def bigrams(spark, sf):
    return phrases.bigram_counts(tokens(spark, sf), min_count=2)


@query(
    "npmi_phrases",
    "T6 J5 O1",
    f"WITH {TOKENS}, {UNIGRAMS}, {BIGRAMS}, {SCORED} SELECT a, b, round(npmi, 6) AS npmi, count FROM scored",
)
def npmi_phrases(spark, sf):
    scored = phrases.score_pairs(stored_tokens(spark, sf), min_count=MIN_COUNT, threshold=THRESHOLD)
    return scored.withColumn("npmi", F.round("npmi", 6)).orderBy(F.desc("npmi"), "a", "b")


@query(
    "phrase_screen",
    "T7 D7",
    f"WITH {TOKENS}, {UNIGRAMS}, {BIGRAMS}, {SCORED}, {SCREENED} SELECT a, b, round(npmi, 6) AS npmi, count FROM kept",
)
def phrase_screen(spark, sf):
    return mined(stored_tokens(spark, sf)).withColumn("npmi", F.round("npmi", 6))


@query(
    "apply_phrases",
    "T8 J6",
    f"""WITH {TOKENS}, {UNIGRAMS}, {BIGRAMS}, {SCORED}, {SCREENED},
    hit AS (SELECT date, docid, string_agg(a || '_' || b, ' ' ORDER BY i) AS p, count(*) AS n_phrases
            FROM occ JOIN (SELECT a, b FROM kept) USING (a, b) GROUP BY date, docid)
    SELECT date, docid, len(tokens) + coalesce(n_phrases, 0) AS n,
           md5(array_to_string(tokens, ' ') || coalesce(' ' || p, '')) AS tokens_hash
    FROM toks LEFT JOIN hit USING (date, docid) WHERE len(tokens) > 0""",
)
def apply_phrases(spark, sf):
    rows = phrases.append_phrases(stored_tokens(spark, sf), stored_phrases(spark, sf), ["date", "docid"])
    return rows.where(F.size("tokens") > 0).select(
        "date",
        "docid",
        F.size("tokens_phrased").cast("bigint").alias("n"),
        F.md5(F.array_join("tokens_phrased", " ")).alias("tokens_hash"),
    )


# --- topic words by document frequency, one "topic" per language -------------------

TOP_N = 10

def words_by_df_sql(n: int) -> str:
    return f"""{TOKENS},
dfreq AS (SELECT language, w, count(*) AS df FROM (
  SELECT language, unnest(list_distinct(tokens)) AS w FROM toks) GROUP BY language, w),
tw AS (SELECT CAST(dense_rank() OVER (ORDER BY language) - 1 AS INTEGER) AS topic, pos, w AS word FROM (
  SELECT language, w, row_number() OVER (PARTITION BY language ORDER BY df DESC, w) - 1 AS pos FROM dfreq)
  WHERE pos < {n})"""


def topic_words(spark, sf, n: int) -> DataFrame:
    """The ``n`` words of highest document frequency per language."""
    freq = (
        unnest(tokens(spark, sf), ["language"], F.array_distinct("tokens"), "word")
        .groupBy("language", "word")
        .agg(F.count(F.lit(1)).alias("df"))
    )
    best = top_k(freq, ["language"], [F.desc("df"), F.asc("word")], n, into="pos")
    numbered = best.withColumn("topic", F.dense_rank().over(Window.orderBy("language")) - 1)
    return numbered.select(F.lit(4).alias("k"), "topic", "pos", "word")


def stored_topic_words(spark, sf, n: int) -> DataFrame:
    """The word lists as a model would hand them over: a small stored table."""
    return T.once(spark, sf, f"words{n}", lambda: written(topic_words(spark, sf, n), "words"))


@query(
    "topic_words_by_df",
    "K8 O3 T14",
    f"WITH {words_by_df_sql(50)} SELECT topic, CAST(pos AS BIGINT) AS pos, word FROM tw",
)
def topic_words_by_df(spark, sf):
    rows = topic_words(spark, sf, 50)
    return rows.select("topic", F.col("pos").cast("bigint").alias("pos"), "word")


PAIRED = f"""{words_by_df_sql(TOP_N)},
need AS (SELECT x.topic, least(x.word, y.word) AS a, greatest(x.word, y.word) AS b
  FROM tw x JOIN tw y ON x.topic = y.topic AND x.pos < y.pos),
dw AS (SELECT date, docid, w FROM (SELECT date, docid, unnest(list_distinct(tokens)) AS w FROM toks)
       WHERE w IN (SELECT word FROM tw)),
single AS (SELECT w, count(*) AS n FROM dw GROUP BY w),
joint AS (SELECT x.w AS a, y.w AS b, count(*) AS n FROM dw x JOIN dw y USING (date, docid) WHERE x.w < y.w GROUP BY x.w, y.w),
nd AS (SELECT count(*) AS total FROM toks),
npmis AS (SELECT topic, ln((coalesce(j.n, 0) / total + 1e-12) / ((sa.n / total) * (sb.n / total)))
                        / -ln(coalesce(j.n, 0) / total + 1e-12) AS npmi
  FROM need JOIN single sa ON sa.w = need.a JOIN single sb ON sb.w = need.b
  LEFT JOIN joint j ON j.a = need.a AND j.b = need.b, nd),
per_topic AS (SELECT topic, avg(npmi) AS npmi FROM npmis GROUP BY topic)"""


@query(
    "coherence",
    "T15",
    f"WITH {PAIRED} SELECT topic, round(npmi, 6) AS npmi, total AS n_docs FROM per_topic, nd",
)
def topic_coherence(spark, sf):
    rows = coherence.topic_npmi(stored_tokens(spark, sf), stored_topic_words(spark, sf, TOP_N), tokens="tokens", n=TOP_N)
    return rows.withColumn("npmi", F.round("npmi", 6))


@query(
    "diversity",
    "T16",
    f"""WITH {words_by_df_sql(TOP_N)} SELECT 4 AS k, round(count(DISTINCT word) / count(*), 6) AS topic_diversity FROM tw""",
)
def topic_diversity(spark, sf):
    rows = coherence.diversity(stored_topic_words(spark, sf, TOP_N), ["k"], TOP_N)
    return rows.withColumn("topic_diversity", F.round("topic_diversity", 6))


@query(
    "coherence_table",
    "T17 D13 W6",
    f"""WITH {PAIRED}, d AS (SELECT count(DISTINCT word) / count(*) AS div FROM tw), m AS (SELECT avg(npmi) AS npmi FROM per_topic)
    SELECT 4 AS k, round(npmi, 6) AS mean_npmi, round(div, 6) AS topic_diversity,
    round(npmi * div, 6) AS coherence_diversity, total AS n_docs,
    (SELECT string_agg(printf('%.4f', npmi), ' ' ORDER BY topic) FROM per_topic) AS per_topic_npmi,
    (SELECT string_agg(word, ' ' ORDER BY topic, pos) FROM tw) AS top_words FROM m, d, nd""",
)
def coherence_table(spark, sf):
    rows = coherence.coherence_table(stored_tokens(spark, sf), stored_topic_words(spark, sf, TOP_N), "tokens", TOP_N)
    scores = F.transform("per_topic_npmi", lambda v: F.format_string("%.4f", v))
    return rows.select(
        "k",
        "mean_npmi",
        "topic_diversity",
        F.round("coherence_diversity", 6).alias("coherence_diversity"),
        "n_docs",
        F.array_join(scores, " ").alias("per_topic_npmi"),
        F.array_join(F.flatten("top_words"), " ").alias("top_words"),
    )


@query(
    "topic_separation",
    "T29",
    f"""WITH {words_by_df_sql(500)}, s AS (SELECT topic, count(*) AS n FROM tw GROUP BY topic)
    SELECT x.topic AS a, y.topic AS b, count(*) AS n_shared,
    round(count(*) / (any_value(sx.n) + any_value(sy.n) - count(*)), 6) AS jaccard
    FROM tw x JOIN tw y ON x.word = y.word AND x.topic < y.topic
    JOIN s sx ON sx.topic = x.topic JOIN s sy ON sy.topic = y.topic GROUP BY x.topic, y.topic""",
)
def topic_separation(spark, sf):
    return coherence.separation(stored_topic_words(spark, sf, 500), 500)
