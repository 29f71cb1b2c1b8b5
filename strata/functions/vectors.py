"""Expressions over ``array<double>`` columns."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` applied to ``value``, which is evaluated once.

    Inside a lambda, an outer expression would be evaluated for every element."""
    return F.transform(F.array(value), body)[0]


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where one side is a zero vector."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def normalised(a: Column) -> Column:
    """Scaled to sum 1; a zero vector stays as it is."""
    with_sum = F.struct(a.alias("a"), total(a).alias("s"))

    def scale(v: Column) -> Column:
        return F.transform(v["a"], lambda x: F.when(v["s"] > 0, x.cast("double") / v["s"]).otherwise(0.0))

    return let(with_sum, scale)


def hellinger_similarity(p: Column, q: Column) -> Column:
    """1 minus the Hellinger distance of the two normalised vectors."""
    parts = F.zip_with(
        normalised(p), normalised(q), lambda x, y: F.pow(F.sqrt(x) - F.sqrt(y), F.lit(2.0))
    )
    return 1.0 - F.sqrt(total(parts)) / F.sqrt(F.lit(2.0))


def unit(a: Column) -> Column:
    """Scaled to length 1; the dot product of two such vectors is their cosine."""
    with_size = F.struct(a.alias("a"), norm(a).alias("s"))

    def scale(v: Column) -> Column:
        return F.transform(v["a"], lambda x: F.when(v["s"] > 0, x.cast("double") / v["s"]).otherwise(0.0))

    return let(with_size, scale)


def roots(a: Column) -> Column:
    """Square roots of the vector scaled to sum 1."""
    return F.transform(normalised(a), lambda x: F.sqrt(x))


def hellinger_of_roots(p: Column, q: Column) -> Column:
    """Hellinger similarity of two vectors given by :func:`roots`."""
    return 1.0 - F.sqrt(F.greatest(1.0 - dot(p, q), F.lit(0.0)))


def dominant(theta: Column, hits: Column | None = None) -> Column:
    """0-based index of the first maximum; NULL for a bag without known words."""
    index = (F.array_position(theta, F.array_max(theta)) - 1).cast("int")
    return index if hits is None else F.when(hits > 0, index)


def spread(df: DataFrame, column: str, k: int, prefix: str = "topic_") -> DataFrame:
    """Array column to ``k`` wide columns."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, *[F.col(column)[i].alias(f"{prefix}{i}") for i in range(k)])


def gather(df: DataFrame, k: int, into: str = "theta", prefix: str = "topic_") -> DataFrame:
    """``k`` wide columns to one array column."""
    wide = [f"{prefix}{i}" for i in range(k)]
    rest = [c for c in df.columns if c not in wide]
    return df.select(*rest, F.array(*[F.col(c) for c in wide]).alias(into))


def as_array(df: DataFrame, column: str) -> DataFrame:
    """ML vector column to an array column; arrays pass unchanged."""
    if isinstance(df.schema[column].dataType, VectorUDT):
        return df.withColumn(column, vector_to_array(column))
    return df
