"""Topic coherence and diversity from topic-word and token tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators.ranking import unnest
from strata.session import broadcast_if_small, written

EPSILON = 1e-12


def top_words(topic_words: DataFrame, by: list[str], n: int = 10) -> DataFrame:
    """First ``n`` words per topic; rows are ``by, topic, pos (from 0), word``."""
    return topic_words.where(F.col("pos") < n).select(*by, "topic", "pos", "word")


def diversity(topic_words: DataFrame, by: list[str], n: int = 10) -> DataFrame:
    """Distinct share of all top words per model; 0 without words."""
    words = top_words(topic_words, by, n)
    return words.groupBy(*by).agg(
        (F.count_distinct("word") / F.count("word")).alias("topic_diversity")
    )


def word_pairs(topic_words: DataFrame, by: list[str], n: int = 10) -> DataFrame:
    """The pairs of top words that a topic needs, smaller word first.

    A topic has ``n`` words, so this is a table of ``n (n - 1) / 2`` rows per topic."""
    words = top_words(topic_words, by, n)
    left = words.select(*by, "topic", F.col("pos").alias("i"), F.col("word").alias("u"))
    right = words.select(*by, "topic", F.col("pos").alias("j"), F.col("word").alias("v"))
    both = left.join(right, [*by, "topic"]).where(F.col("i") < F.col("j"))
    return both.select(
        *by, "topic", "i", "j", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")
    )


def co_counts(docs: DataFrame, needed: DataFrame, words: DataFrame, tokens: str) -> DataFrame:
    """In how many documents each needed pair occurs; a pair (w, w) counts the word itself.

    Documents are cut down to topic words in place, so the corpus is read once
    and only counts are shuffled.
    """
    vocabulary = words.agg(F.collect_set("word")).scalar()
    wanted = needed.select("a", "b").unionByName(
        words.select(F.col("word").alias("a"), F.col("word").alias("b"))
    ).distinct()
    # Never NULL, so that no NULL check is pushed below the projection and
    # evaluates the tokens twice.
    known = F.coalesce(F.array_intersect(F.col(tokens), vocabulary), F.array().cast("array<string>"))
    held = docs.select(known.alias("v"))
    pairs = unnest(held, ["v"], "v", "a").join(broadcast_if_small(wanted), "a")
    return (
        pairs.where(F.array_contains("v", F.col("b")))
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def topic_npmi(
    docs: DataFrame,
    topic_words: DataFrame,
    by: list[str] | None = None,
    tokens: str = "tokens_phrased",
    n: int = 10,
) -> DataFrame:
    """Document-level NPMI per topic: ``by, topic, npmi, n_docs``.

    The denominator is the number of all documents.  A pair counts only if both
    words occur; a pair that never occurs together gets a smoothed joint
    probability; a topic without countable pairs scores 0.
    """
    by = by or []
    words = top_words(topic_words, by, n)
    needed = word_pairs(topic_words, by, n)
    counts = written(co_counts(docs, needed, words.select("word").distinct(), tokens), "pairs")
    n_docs = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    single = counts.where(F.col("a") == F.col("b"))
    pairs = (
        needed.join(single.select("a", F.col("n").alias("na")), "a")
        .join(single.select(F.col("b"), F.col("n").alias("nb")), "b")
        .join(counts.select("a", "b", "n"), ["a", "b"], "left")
        .withColumn("total", n_docs)
    )
    joint = F.coalesce("n", F.lit(0)) / F.col("total") + F.lit(EPSILON)
    pmi = F.ln(joint / ((F.col("na") / F.col("total")) * (F.col("nb") / F.col("total"))))
    scored = pairs.withColumn("npmi", F.try_divide(pmi, -F.ln(joint)))
    means = scored.groupBy(*by, "topic").agg(F.avg("npmi").alias("npmi"))
    topics = words.select(*by, "topic").distinct()
    return (
        topics.join(means, [*by, "topic"], "left")
        .withColumn("npmi", F.coalesce("npmi", F.lit(0.0)))
        .withColumn("n_docs", n_docs)
    )


def coherence_table(
    docs: DataFrame, topic_words: DataFrame, tokens: str = "tokens_phrased", n: int = 10, digits: int = 6
) -> DataFrame:
    """One row per model size ``k`` with mean NPMI, diversity, their product,
    the per-topic scores and the top words."""
    topics = topic_npmi(docs, topic_words, ["k"], tokens, n)
    words = top_words(topic_words, ["k"], n).groupBy("k", "topic").agg(
        F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("w")
    )
    listed = topics.join(words, ["k", "topic"]).groupBy("k").agg(
        F.avg("npmi").alias("mean_npmi"),
        F.max("n_docs").alias("n_docs"),
        F.array_sort(F.collect_list(F.struct("topic", "npmi", "w"))).alias("t"),
    )
    table = listed.join(diversity(topic_words, ["k"], n), "k")
    return table.select(
        "k",
        F.round("mean_npmi", digits).alias("mean_npmi"),
        F.round("topic_diversity", digits).alias("topic_diversity"),
        F.round(F.col("mean_npmi") * F.col("topic_diversity"), digits).alias("coherence_diversity"),
        "n_docs",
        F.transform("t", lambda t: t["npmi"]).alias("per_topic_npmi"),
        F.transform("t", lambda t: F.transform(t["w"], lambda w: w["word"])).alias("top_words"),
    )


def separation(topic_words: DataFrame, n: int = 500) -> DataFrame:
    """Jaccard similarity of the top word sets of topics that share a word.

    Topics without a common word have similarity 0 and no row."""
    words = topic_words.where(F.col("pos") < n).select("topic", "word").distinct()
    sizes = words.groupBy("topic").agg(F.count(F.lit(1)).alias("s"))
    left = words.select(F.col("topic").alias("a"), "word")
    right = words.select(F.col("topic").alias("b"), "word")
    shared = (
        left.join(right, "word")
        .where(F.col("a") < F.col("b"))
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("n_shared"))
    )
    sized = shared.join(sizes.select(F.col("topic").alias("a"), F.col("s").alias("sa")), "a").join(
        sizes.select(F.col("topic").alias("b"), F.col("s").alias("sb")), "b"
    )
    jaccard = F.col("n_shared") / (F.col("sa") + F.col("sb") - F.col("n_shared"))
    return sized.select("a", "b", "n_shared", F.round(jaccard, 6).alias("jaccard"))
