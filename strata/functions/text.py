"""Tokenizers, analyzers and word statistics as column expressions.

An analyzer is any function ``Column -> Column`` from a string to an array of
strings; NULL text gives an empty array.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from strata.functions.words import (
    ELISIONS,
    ENGLISH_MARKERS,
    ENGLISH_STOPWORDS,
    FRENCH_STOPWORDS,
)

Analyzer = Callable[[Column], Column]

WORD = r"[\p{L}\p{N}]+"
WORD_WITH_APOSTROPHE = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def simple_tokens(text) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit(WORD), F.lit(0))


def without(tokens, words) -> Column:
    """Drop every token that is in the fixed list ``words``."""
    kept = sorted(set(words))
    return F.filter(_col(tokens), lambda t: ~t.isin(kept))


def light_tokens(text) -> Column:
    """Simple tokens without French function words: the default index analyzer."""
    return without(simple_tokens(text), FRENCH_STOPWORDS)


# Ending rules of a light French stemmer, after Savoy's published description:
# (shortest token it applies to, ending, replacement).  The first rule whose
# ending matches is applied; accents and doubled letters are folded afterwards.
LIGHT_ENDINGS = [
    (9, "issement", "ir"),
    (8, "issant", "ir"),
    (7, "ement", "e"),
    (9, "atrice", "er"),
    (8, "ateur", "er"),
    (9, "isation", ""),
    (8, "ation", ""),
    (8, "ition", ""),
    (7, "euse", "eu"),
    (8, "ive", "if"),
    (8, "ique", ""),
    (8, "esse", ""),
]

LAST_LETTERS = "(?:(?<=.{3})ie|(?<=.{4})e{0,2}r?)$"

# Accented letters and what they fold to.
FOLD_FROM = "àáâôèéêëùûîïç"
FOLD_TO = "aaaoeeeeuuiic"


def _singular(token: Column) -> Column:
    longer = F.regexp_replace(F.regexp_replace(token, "([^e])aux$", "$1al"), "[xs]$", "")
    return (
        F.when(F.length(token) > 5, longer)
        .when(F.length(token) > 3, F.regexp_replace(token, "[xs]$", ""))
        .otherwise(token)
    )


def _without_ending(token: Column) -> Column:
    """The first matching ending rule applied."""
    ended = None
    for shortest, ending, replacement in LIGHT_ENDINGS:
        hit = token.endswith(ending) & (F.length(token) >= shortest)
        stem = F.substring(token, F.lit(1), F.length(token) - len(ending))
        value = F.concat(stem, F.lit(replacement)) if replacement else stem
        ended = F.when(hit, value) if ended is None else ended.when(hit, value)
    return ended.otherwise(token)


def _folded(stem: Column) -> Column:
    """Accents, doubled letters and a final ie, e, ee, r or er folded away in longer stems."""
    plain = F.regexp_replace(F.translate(stem, FOLD_FROM, FOLD_TO), r"(\p{L})\1", "$1")
    return F.when(F.length(stem) > 4, F.regexp_replace(plain, LAST_LETTERS, "")).otherwise(stem)


def french_endings(text) -> Column:
    """French tokens after elision, stop words and ending rules, not yet folded."""
    lowered = F.lower(F.coalesce(_col(text), F.lit("")))
    raw = F.regexp_extract_all(lowered, F.lit(WORD_WITH_APOSTROPHE), F.lit(0))
    elided = F.transform(
        raw, lambda t: F.regexp_replace(t, "^(?:" + "|".join(ELISIONS) + ")['’]", "")
    )
    # One pass per step: a step's input is then a value, not a repeated expression.
    singular = F.transform(without(elided, FRENCH_STOPWORDS), _singular)
    return F.transform(singular, _without_ending)


def french_tokens(text) -> Column:
    """French analysis: tokens, elision, lower case, stop words, light stems."""
    return F.transform(french_endings(text), _folded)


def stop_forms(analyzer_words: list[str] | None = None) -> list[str]:
    """French and English stop words, raw forms plus any analyzed forms given."""
    return sorted(set(FRENCH_STOPWORDS) | set(ENGLISH_STOPWORDS) | set(analyzer_words or []))


def analyzed_stop_forms(spark, analyzer: Analyzer) -> list[str]:
    """Raw stop words united with what ``analyzer`` turns them into."""
    raw = stop_forms()
    one = spark.range(1).select(analyzer(F.lit(" ".join(raw))).alias("forms"))
    return stop_forms(one.first()["forms"])


def content_tokens(tokens, stop_words=None, min_length: int = 3) -> Column:
    """Topic-model tokens: no stop words, long enough, not all digits."""
    kept = without(tokens, stop_forms() if stop_words is None else stop_words)
    return F.filter(kept, lambda t: (F.length(t) >= min_length) & ~t.rlike("^[0-9]+$"))


def adjacent_pairs(tokens) -> Column:
    """Array of ``struct(pos, a, b)`` of neighbouring tokens; empty below two tokens."""
    t = _col(tokens)
    rest = F.greatest(F.size(t) - 1, F.lit(0))
    return F.zip_with(
        F.slice(t, F.lit(1), rest), F.slice(t, F.lit(2), rest), lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    )


def windows(tokens, width: int) -> Column:
    """All runs of ``width`` neighbouring tokens, joined by a space."""
    t = _col(tokens)
    count = F.greatest(F.size(t) - (width - 1), F.lit(0))
    starts = F.when(count > 0, F.sequence(F.lit(1), F.greatest(count, F.lit(1)))).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(starts, lambda i: F.array_join(F.slice(t, i, F.lit(width)), " "))


def words_by_space(text) -> Column:
    """Word count that splits at every single space (empty pieces count)."""
    return F.size(F.split(_col(text), " "))


def words_by_blank(text) -> Column:
    """Word count that splits at runs of white space (empty pieces do not count)."""
    return F.size(F.filter(F.split(_col(text), r"\s+"), lambda x: x != ""))


def token_count(text, analyzer: Analyzer = simple_tokens) -> Column:
    """Number of tokens; the tokenizer is a parameter."""
    return F.size(analyzer(_col(text)))


def encoder_token_count(make_encoder: Callable[[], Callable[[str], list]]):
    """Arrow-batched token counter around an external subword encoder.

    ``make_encoder`` runs once per batch on the executors and returns a
    function from text to a list of tokens.
    """
    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        encode = make_encoder()
        return texts.fillna("").map(lambda t: len(encode(t))).astype("int32")

    return count


def english_density(text) -> Column:
    """Share of words that are English markers; 0 for a text without words."""
    pattern = r"(?<![\p{L}\p{N}_])(?:" + "|".join(ENGLISH_MARKERS) + r")(?![\p{L}\p{N}_])"
    words = words_by_blank(text)
    hits = F.regexp_count(F.lower(_col(text)), F.lit(pattern))
    return F.when(words > 0, hits / words).otherwise(F.lit(0.0))


def bare_docid(docid) -> Column:
    """``doc123`` -> ``123``; other identifiers are left alone."""
    return F.regexp_replace(_col(docid), r"^doc(\d)", "$1")


def numeric_docid(docid) -> Column:
    """Cast form of the same normalisation: every ``doc`` removed, NULL if not a number."""
    return F.replace(_col(docid), F.lit("doc"), F.lit("")).try_cast("bigint")
