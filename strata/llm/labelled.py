"""Bounded samples of labelled documents, for models that are trained on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labelled rows that a model is trained on, and the longest text among them.
SAMPLE_ROWS = 4000
SAMPLE_BYTES = 1 << 16

FOLDS = 5


def held_out(column: str = "doc_id") -> Column:
    """Whether a row's label may not be used: crc32 of the doc_id as text is a multiple of five.

    A null doc_id is read as the empty text, so it is held out.
    """
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def sample(
    docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES
) -> list[tuple[int, str, int]]:
    """At most ``rows`` training rows (doc_id, text, label), chosen by a hash of doc_id.

    Rows of the held-out fold, null labels and texts longer than ``most_bytes``
    are left out.  A doc_id with several labels has the largest, one with
    several texts the smallest.
    """
    usable = labels.where(~held_out() & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    each = usable.groupBy("doc_id").agg(F.max(label).alias("label"))
    # The hash orders the rows; ``rows`` is a parameter, so the chosen ids can be broadcast.
    chosen = each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.where(F.octet_length("text") <= most_bytes).select("doc_id", "text")
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    got = [(r["doc_id"], r["text"], int(r["label"])) for r in found.collect()]
    return sorted(got)
