"""Bottom-k sketches of word shingles: document fingerprints that can be merged.

A sketch holds the k smallest distinct hashes of a set.  The sketch of a union
is the k smallest of the members' sketches, so parts can be sketched where they
lie and merged later.  Two sketches estimate resemblance from the k smallest
hashes of the union, containment from resemblance and the two sizes, and one
estimates the size of its set from its largest hash.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.shingles import shingle_hashes

K = 128
_SPAN = float(2**64)


def sketch(text: str | None, k: int = K) -> np.ndarray:
    """The ``k`` smallest distinct shingle hashes of a whole text, ascending."""
    hashes = shingle_hashes(text)
    if len(hashes) > 8 * k:
        # Hashes are uniform: the smallest lie below this bound nearly always.
        low = hashes[hashes < np.uint64(int(_SPAN * 4 * k / len(hashes)))]
        low = np.unique(low)
        if len(low) >= k:
            return low[:k]
    return np.unique(hashes)[:k]


def merge(*sketches: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of the sketched sets."""
    return np.unique(np.concatenate(sketches))[:k]


def distinct(own: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below ``k``."""
    if len(own) < k:
        return float(len(own))
    return (k - 1) / ((float(own[-1]) + 1.0) / _SPAN)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the union that both sets hold; two empty sets are alike."""
    if not len(a) and not len(b):
        return 1.0
    union = merge(a, b, k=k)
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(both, union, assume_unique=True).sum()) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the first set that the second holds; an empty set is contained."""
    if not len(a):
        return 1.0
    both = resemblance(a, b, k) * distinct(merge(a, b, k=k), k)
    return min(1.0, both / distinct(a, k))


def pack(own: np.ndarray) -> str:
    """A sketch as text."""
    return base64.b64encode(own.astype("<u8").tobytes()).decode("ascii")


def unpack(packed: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(packed), dtype="<u8")


def fingerprints(docs: DataFrame, column: str = "text", into: str = "fingerprint", k: int = K) -> DataFrame:
    """Add the packed sketch of every whole text; null and empty texts have an empty one."""

    @F.pandas_udf("string")
    def packed(texts):
        return texts.map(lambda text: pack(sketch(text, k)), na_action=None)

    return docs.withColumn(into, packed(F.coalesce(F.col(column), F.lit(""))))


def merged(rows: DataFrame, group: list[str], column: str = "fingerprint", k: int = K) -> DataFrame:
    """One sketch per group of sketches.

    Sketches are merged within every task first, so a group sends one sketch per
    task, whatever its size.
    """

    def partial(batches):
        import pandas as pd

        held: dict[tuple, np.ndarray] = {}
        for frame in batches:
            for key, packed in zip(frame[group].astype(object).itertuples(index=False, name=None), frame[column]):
                key = tuple(None if pd.isna(v) else v for v in key)
                own = unpack(packed or "")
                held[key] = merge(held[key], own, k=k) if key in held else own
                if len(held) >= 10_000:
                    yield _frame(held, group, column)
                    held = {}
        yield _frame(held, group, column)

    def final(frame):
        own = merge(*[unpack(packed or "") for packed in frame[column]], k=k)
        return frame.iloc[:1].assign(**{column: pack(own)})

    narrow = rows.select(*group, column)
    schema = narrow.schema
    reduced = narrow.mapInPandas(partial, schema)
    if len(group):
        return reduced.groupBy(*group).applyInPandas(final, schema)
    return reduced.coalesce(1).mapInPandas(partial, schema)


def _frame(held, group, column):
    import pandas as pd

    keys = list(held)
    columns = {g: pd.Series([key[i] for key in keys], dtype=object) for i, g in enumerate(group)}
    return pd.DataFrame({**columns, column: [pack(held[key]) for key in keys]})


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the next text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _ranges(docs: DataFrame, n: int) -> list[int]:
    """Smallest doc_id of every range but the first: at most ``n`` numbers."""
    ranged = docs.where("doc_id is not null").select("doc_id").repartitionByRange(n, "doc_id")
    starts = ranged.groupBy(F.spark_partition_id().alias("part")).agg(F.min("doc_id").alias("first"))
    return sorted(row["first"] for row in starts.collect())[1:]


def _part(bounds: np.ndarray, ids: pa.Array) -> pa.Array:
    numbers = np.asarray(ids.fill_null(np.iinfo(np.int64).min), dtype=np.int64)
    return pa.array(np.searchsorted(bounds, numbers, side="right"), pa.int32())


def neighbours(docs: DataFrame, k: int = K, partitions: int | None = None) -> DataFrame:
    """Fingerprints of every text, its edited text and how like it is to its neighbour.

    ``docs`` needs doc_id (long) and text.  The next document is the next one by
    doc_id (nulls first; rows that repeat a doc_id by text), after the last the
    first.  Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, shingles_estimate and
    containment_edited.  A null text is empty; two empty texts are alike, an
    empty and another are not.  A table of one row has itself as the next.

    Documents are cut into ranges of doc_id by stored bounds.  Every range gets
    the first document of the range after it as well, so neighbours meet in one
    task and texts are moved once.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = np.array(_ranges(rows, n), dtype=np.int64)
    schema = "doc_id long, text string, part int"

    def parted(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, _part(bounds, batch.column("doc_id"))], ["doc_id", "text", "part"]
            )

    marked = rows.mapInArrow(parted, schema)
    firsts = _first_rows(rows, bounds)
    after = marked.withColumn("after", F.lit(False)).unionByName(firsts)
    order = ["part", "after", F.col("doc_id").asc_nulls_first(), "text"]
    ranged = after.repartitionByRange(n, "part").sortWithinPartitions(*order)

    def compared(batches):
        held = None  # the row whose neighbour comes next
        for batch in batches:
            out = []
            for number, value, part, extra in zip(*[batch.column(c) for c in ("doc_id", "text", "part", "after")]):
                text, part = value.as_py(), part.as_py()
                own = sketch(text, k)
                if held is not None and held[2] == part:
                    out.append(_compared_row(held, text, own, k))
                held = None if extra.as_py() else (number.as_py(), text, part, own)
            yield pa.RecordBatch.from_pylist(out, schema=_RESULT)

    return ranged.mapInArrow(compared, _RESULT_DDL)


_RESULT = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
        ("shingles_estimate", pa.float64()), ("containment_edited", pa.float64()),
    ]
)
_RESULT_DDL = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, shingles_estimate double, containment_edited double"
)


def _compared_row(held, following: str, next_own: np.ndarray, k: int) -> dict:
    number, text, _, own = held
    changed = edited(text, following)
    changed_own = sketch(changed, k)
    return {
        "doc_id": number,
        "n_chars": len(text),
        "edited_sha256": hashlib.sha256(changed.encode("utf-8")).hexdigest(),
        "fingerprint": pack(own),
        "edited_fingerprint": pack(changed_own),
        "near_edited": resemblance(own, changed_own, k),
        "near_next": resemblance(own, next_own, k),
        "shingles_estimate": distinct(own, k),
        "containment_edited": containment(own, changed_own, k),
    }


def _first_rows(rows: DataFrame, bounds: np.ndarray) -> DataFrame:
    """The first row of every range, as the last of the range before it; the whole table's first after the last."""
    spark = rows.sparkSession
    smallest = rows.agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("with_id"))
    smallest = smallest.first()
    lead = None if smallest["with_id"] < smallest["n"] else smallest["doc_id"]
    heads = [(int(b), i) for i, b in enumerate(bounds)] + [(lead, len(bounds))]
    # One row per range: the number of ranges is a parameter.
    wanted = F.broadcast(spark.createDataFrame(heads, "__id long, part int"))
    found = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("__id")))
    first = found.groupBy("part").agg(F.min("text").alias("text"))
    return first.join(wanted, "part").select(F.col("__id").alias("doc_id"), "text", "part", F.lit(True).alias("after"))
