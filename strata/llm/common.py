"""What several operators share: words, white space, bounded key filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata import session

# White space that separates words, and a word (fixed values of the data contract).
WHITE = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"


def text_of(column: str = "text") -> Column:
    """The text, null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def without_white(text: Column) -> Column:
    """The text without any white space character."""
    for character in WHITE:
        text = F.replace(text, F.lit(character), F.lit(""))
    return text


def likely_in(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``key`` occurs in the one column of ``keys``, and a few others."""
    return session.likely_in(df, [key], keys.select(F.col(keys.columns[0]).alias(key)))
