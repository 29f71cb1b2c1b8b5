"""The given tables seen as a sliced collection, in Spark and in SQL.

documents -> (docid, contents, language, date, split): the twenty sources become
twenty months from 2022-06 on; months up to 2023-02 are the train split.
benchmark -> queries (qid, query).
conversations -> a query log (date, qid, query, split) and repeated-key records.
embeddings -> topic vectors theta = |x| / sum |x| of 64 topics in monthly slices.
Judgements are derived from whole texts: a document is judged for a query when
they share a pair of neighbouring words; the grade is 2, 1 or 0 by the share of
the query's distinct pairs that the document holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import keys as K
from strata.functions import text as X
from strata.functions import vectors as V
from strata.functions.words import FRENCH_STOPWORDS
from strata.operators import retrieval, segments
from strata.operators.ranking import unnest
from strata.session import MAX_BROADCAST_VECTORS, broadcast_if_small, scratch_path, spread_join, written

TOPICS = 64
CHANGE = "2022-10"
LAST_TRAIN = "2023-02"
RUN_DEPTH = 100


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table whose rows are costly to analyze, in enough partitions for every core.

    Only an input of fewer splits than cores is spread; a large one is left as it is read.
    """
    rows = table(spark, sf, name)
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def month(number: Column) -> Column:
    """Month string of a 0-based slice number."""
    return F.date_format(F.add_months(F.lit("2022-06-01").cast("date"), number.cast("int")), "yyyy-MM")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    rows = texts(spark, sf, "documents").select(
        F.concat(F.lit("doc"), F.col("doc_id")).alias("docid"),
        F.col("text").alias("contents"),
        F.col("lang").alias("language"),
        month(F.substring("source", 4, 10)).alias("date"),
    )
    return rows.withColumn("split", K.split_of(F.col("date"), LAST_TRAIN))


def queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(
        F.col("item_id").cast("string").alias("qid"), F.col("text").alias("query")
    )


def query_log(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select(
        month(F.col("turn")).alias("date"), F.col("conv_id").cast("string").alias("qid"), F.col("text").alias("query")
    )
    return rows.withColumn("split", K.split_of(F.col("date"), "2022-08"))


def whole_conversations(spark: SparkSession, sf: str) -> DataFrame:
    """``qid, query``: the texts of all turns of a conversation, in order."""
    turns = table(spark, sf, "conversations").groupBy(F.col("conv_id").cast("string").alias("qid")).agg(
        F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns")
    )
    return turns.select("qid", F.array_join(F.transform("turns", lambda t: t["text"]), "\n").alias("query"))


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose docid repeats: conversations by id, the role as slice."""
    return table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("docid"),
        F.col("role").alias("date"),
        F.col("turn"),
        F.col("text").alias("contents"),
    )


def visits(spark: SparkSession, sf: str) -> DataFrame:
    """Query instances of a day: the users of the event stream."""
    return table(spark, sf, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("date"), F.col("user_id").cast("string").alias("qid")
    )


def theta(column: str = "embedding") -> Column:
    return V.normalised(F.transform(column, lambda x: F.abs(x.cast("double"))))


def topics(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.concat(F.lit("doc"), F.col("vec_id")).alias("docid"),
        F.col("vec_id").cast("string").alias("qid"),
        month(F.col("label")).alias("date"),
        "label",
        theta().alias("theta"),
    )


def word_pairs(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Distinct pairs of neighbouring words of a text as an array of strings."""
    tokens = df.select(*keys, X.simple_tokens(text).alias("t"))
    joined = F.transform(X.adjacent_pairs("t"), lambda p: F.concat_ws(" ", p["a"], p["b"]))
    return tokens.select(*keys, F.array_distinct(joined).alias("pairs"))


def qrels(spark: SparkSession, sf: str) -> DataFrame:
    docs = word_pairs(documents(spark, sf), ["date", "docid"], "contents")
    held = unnest(docs, ["date", "docid"], "pairs", "p")
    posed = word_pairs(queries(spark, sf), ["qid"], "query")
    wanted = unnest(posed, ["qid", F.size("pairs").alias("n")], "pairs", "p")
    shared = held.join(broadcast_if_small(wanted), "p")
    covered = shared.groupBy("date", "qid", "docid").agg((F.count(F.lit(1)) / F.first("n")).alias("c"))
    grade = F.when(F.col("c") >= 0.5, 2).when(F.col("c") >= 0.1, 1).otherwise(0)
    return covered.select("date", "qid", "docid", grade.alias("rel"))


# --- stored intermediate tables --------------------------------------------------
# Built once per application and input, below the shared folder: the index, the
# judgements and the retrieval run are parquet hand-overs between jobs.

_stored: dict[tuple[str, str, str], object] = {}


def once(spark: SparkSession, sf: str, name: str, build):
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _stored:
        _stored[key] = build()
    return _stored[key]


def index(spark: SparkSession, sf: str) -> retrieval.Index:
    def build():
        return retrieval.write_index(documents(spark, sf), scratch_path(spark, "index"))

    return once(spark, sf, "index", build)


def store(spark: SparkSession, sf: str) -> segments.Store:
    """The documents as a segmented index: half of them with other texts first, then all, then some slices compacted."""

    def build():
        docs = documents(spark, sf).select("date", "docid", "contents")
        path = scratch_path(spark, "segments")
        stale = docs.where(F.crc32("docid") % 2 == 0).withColumn("contents", F.concat_ws(" ", "docid", F.lit("stale stale words")))
        segments.append(stale, path)
        grown = segments.append(docs, path)
        return segments.compact(grown, [d for _, d, _ in grown.parts if d <= CHANGE])

    return once(spark, sf, "store", build)


def stored_qrels(spark: SparkSession, sf: str) -> DataFrame:
    return once(spark, sf, "qrels", lambda: written(qrels(spark, sf), "qrels"))


def run(spark: SparkSession, sf: str) -> DataFrame:
    """Best 100 documents of every query in every slice."""

    def build():
        found = retrieval.search(index(spark, sf), queries(spark, sf), ["date", "qid"], RUN_DEPTH)
        return written(found, "run")

    return once(spark, sf, "run", build)


def compared(spark: SparkSession, sf: str, rows: DataFrame, counted: DataFrame) -> DataFrame:
    """Add cosine and Hellinger similarity of the topic vectors of ``qid`` and ``docid``.

    Lengths and roots are computed once per vector, not once per pair."""
    vectors = topics(spark, sf).select(
        "qid", "docid", F.struct(V.unit(F.col("theta")).alias("u"), V.roots(F.col("theta")).alias("r")).alias("v")
    )
    q = vectors.select("qid", F.col("v").alias("__q"))
    d = vectors.select("docid", F.col("v").alias("__d"))
    options = dict(counted=counted, broadcast_rows=MAX_BROADCAST_VECTORS)
    pairs = spread_join(spread_join(rows, q, ["qid"], **options), d, ["docid"], **options)
    return pairs.select(
        *rows.columns,
        F.round(V.dot(F.col("__q.u"), F.col("__d.u")), 6).alias("cos"),
        F.round(V.hellinger_of_roots(F.col("__q.r"), F.col("__d.r")), 6).alias("hell"),
    )


def topical(spark: SparkSession, sf: str) -> DataFrame:
    """Run rows with topic vectors on both sides and their similarities."""
    found = run(spark, sf)
    rows = compared(spark, sf, found.select("date", "qid", "docid", F.col("score").alias("bm25")), found)
    return rows.withColumnsRenamed({"cos": "topic", "hell": "hellinger"})


# --- the same in SQL ----------------------------------------------------------------

MONTH = "strftime(DATE '2022-06-01' + to_months(CAST({} AS INTEGER)), '%Y-%m')"
WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(FRENCH_STOPWORDS)))

DOCS = f"""docs AS (
  SELECT *, CASE WHEN date <= '{LAST_TRAIN}' THEN 'train' ELSE 'test' END AS split FROM (
    SELECT 'doc' || doc_id AS docid, text AS contents, lang AS language,
           {MONTH.format("substr(source, 4)")} AS date FROM documents))"""

POSED = "posed AS (SELECT CAST(item_id AS VARCHAR) AS qid, text AS query FROM benchmark)"

LOG = f"""log AS (
  SELECT *, CASE WHEN date <= '2022-08' THEN 'train' ELSE 'test' END AS split FROM (
    SELECT {MONTH.format("turn")} AS date, CAST(conv_id AS VARCHAR) AS qid, text AS query FROM conversations))"""

WHOLE = """whole AS (
  SELECT CAST(conv_id AS VARCHAR) AS qid, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"""

RECORDS = """records AS (
  SELECT CAST(conv_id AS VARCHAR) AS docid, role AS date, turn, text AS contents FROM conversations)"""

VISITS = "visits AS (SELECT strftime(ts, '%Y-%m-%d') AS date, CAST(user_id AS VARCHAR) AS qid FROM events)"

THETAS = f"""thetas AS (
  SELECT 'doc' || vec_id AS docid, CAST(vec_id AS VARCHAR) AS qid, {MONTH.format("label")} AS date, label,
         list_transform(a, lambda x: x / list_sum(a)) AS theta
  FROM (SELECT *, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS a FROM embeddings))"""

# Terms after stop words, posting tables, and scores of all (slice, query, document) matches.
TERMS = f"""terms AS (
  SELECT date, docid, term FROM (SELECT date, docid, unnest({WORDS.format('contents')}) AS term FROM docs)
  WHERE term NOT IN ({STOP}))"""

POSTINGS = """postings AS (
  SELECT date, docid, term, count(*) AS tf, any_value(dl) AS dl
  FROM terms JOIN (SELECT date, docid, count(*) AS dl FROM terms GROUP BY date, docid) USING (date, docid)
  GROUP BY date, docid, term),
slices AS (
  SELECT date, count(*) AS n_docs, avg(dl) AS avgdl
  FROM (SELECT date, docid, count(*) AS dl FROM terms GROUP BY date, docid) GROUP BY date),
dfs AS (SELECT date, term, count(*) AS df FROM postings GROUP BY date, term)"""


def matches_sql(source: str, into: str, keys: str = "qid") -> str:
    """CTEs that score every query of ``source(keys, query)`` in every slice."""
    return f"""{into}_terms AS (
  SELECT {keys}, term, count(*) AS qtf FROM (SELECT {keys}, unnest({WORDS.format('query')}) AS term FROM {source})
  WHERE term NOT IN ({STOP}) GROUP BY {keys}, term),
{into} AS (
  SELECT date, {keys}, docid,
         round(sum(qtf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf
                   / (tf + 0.9 * (0.6 + 0.4 * dl / avgdl))), 6) AS score
  FROM postings JOIN {into}_terms USING (term) JOIN dfs USING (date, term) JOIN slices USING (date)
  GROUP BY date, {keys}, docid)"""


def unit_hash_sql(seed: int, *keys: str) -> str:
    """The number in [0, 1) of a key, as :func:`strata.functions.keys.unit_hash` makes it."""
    return f"(('0x' || substr(md5(concat_ws(chr(31), '{seed}', {', '.join(keys)})), 1, 7))::BIGINT / 268435456.0)"


def crc32_sql(key: str) -> str:
    """CRC-32 of an ASCII key, bit by bit."""
    step = "list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, w: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)"
    codes = f"list_prepend(4294967295::BIGINT, list_transform(string_split({key}, ''), lambda s: ord(s)::BIGINT))"
    return f"xor(list_reduce({codes}, lambda c, x: {step}), 4294967295::BIGINT)"


INDEXED = f"{DOCS},\n{TERMS},\n{POSTINGS}"
RUN = f"""{INDEXED},
{POSED},
{matches_sql('posed', 'matches')},
run AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY date, qid ORDER BY score DESC, docid) - 1 AS rank FROM matches)
  WHERE rank < {RUN_DEPTH})"""

_PAIRS = """SELECT DISTINCT {keys}, t[i] || ' ' || t[i + 1] AS p
    FROM (SELECT {keys}, t, unnest(range(1, greatest(len(t), 1))) AS i FROM (SELECT {keys}, {words} AS t FROM {source}))"""

QRELS = f"""qpairs AS (
    {_PAIRS.format(keys='qid', words=WORDS.format('query'), source='posed')}),
dpairs AS (
    {_PAIRS.format(keys='date, docid', words=WORDS.format('contents'), source='docs')}),
qrels AS (
  SELECT date, qid, docid, CASE WHEN c >= 0.5 THEN 2 WHEN c >= 0.1 THEN 1 ELSE 0 END AS rel FROM (
    SELECT date, qid, docid, count(*) / any_value(n) AS c
    FROM dpairs JOIN qpairs USING (p) JOIN (SELECT qid, count(*) AS n FROM qpairs GROUP BY qid) USING (qid)
    GROUP BY date, qid, docid))"""

TOPICAL = """topical AS (
  SELECT r.date, r.qid, r.docid, r.score AS bm25,
         round(list_dot_product(q.theta, d.theta)
               / (sqrt(list_dot_product(q.theta, q.theta)) * sqrt(list_dot_product(d.theta, d.theta))), 6) AS topic,
         round(1 - sqrt(list_sum(list_transform(list_zip(q.theta, d.theta),
               lambda z: (sqrt(z[1]) - sqrt(z[2])) ** 2))) / sqrt(2.0), 6) AS hellinger
  FROM run r JOIN thetas q ON r.qid = q.qid JOIN thetas d ON r.docid = d.docid)"""


def rounded(expression: str, digits: int = 6) -> str:
    """Rounded value without a negative zero."""
    return f"(CASE WHEN round({expression}, {digits}) = 0 THEN 0.0 ELSE round({expression}, {digits}) END)"
