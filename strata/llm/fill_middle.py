"""Fill-in-the-middle transformation by block rotation in place.

A text is three blocks in a row: prefix, middle and suffix.  Two cuts between
lines, drawn from a digest of the doc_id, bound them.  A sentinel is put before
every block in one byte buffer, and the blocks change places by rotation: two
neighbouring blocks are exchanged by reversing each of them and then both
together.  The same rotation with the other length undoes the exchange, and
without its sentinels the buffer is the text again.

Bytes are UTF-8: no byte of a sentinel or line feed occurs inside another
character, so nothing is decoded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sentinels, and the orders of the blocks (fixed values of the data contract).
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
PLAIN, PSM, SPM = "plain", "psm", "spm"

# Bytes that a reversal exchanges at once.
STEP = 1 << 16
# Bytes of UTF-8 that continue a character.
_CONTINUING = bytes(range(0x80, 0xC0))


@dataclass(frozen=True)
class Draw:
    """How forms and cuts are drawn: a seed and two shares in percent."""

    seed: int = 7
    transformed: int = 100  # of the texts that can be transformed
    spm: int = 50  # of the transformed texts; the others are psm

    def numbers(self, doc_id) -> tuple[int, int, int, int]:
        """Four numbers of 32 bits; a null doc_id has no digits."""
        told = f"{self.seed}:{'' if doc_id is None else doc_id}"
        digest = hashlib.sha256(told.encode()).digest()
        return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


# --- rotation -----------------------------------------------------------------------


def reverse(buffer: np.ndarray, start: int, end: int) -> None:
    """Reverse ``buffer[start:end]`` in place; at most ``STEP`` bytes are copied at a time."""
    while end - start > 1:
        n = min(STEP, (end - start) // 2)
        head = buffer[start : start + n][::-1].copy()
        buffer[start : start + n] = buffer[end - n : end][::-1]
        buffer[end - n : end] = head
        start, end = start + n, end - n


def rotate(buffer: np.ndarray, start: int, middle: int, end: int) -> None:
    """Exchange the neighbouring blocks ``[start, middle)`` and ``[middle, end)`` in place."""
    reverse(buffer, start, middle)
    reverse(buffer, middle, end)
    reverse(buffer, start, end)


# --- one text -----------------------------------------------------------------------


def line_cut(text: bytes, breaks: np.ndarray, n: int) -> int:
    """Where the first ``n`` lines end; ``breaks`` are the places of the line feeds."""
    if n == 0:
        return 0
    return int(breaks[n - 1]) + 1 if n <= len(breaks) else len(text)


def points(part: bytes) -> int:
    """Code points of UTF-8."""
    return len(part.translate(None, _CONTINUING))


@dataclass
class Transformed:
    lines: int
    form: str
    prefix: bytes
    middle: bytes
    output: bytes


def transform_text(doc_id, text: bytes, draw: Draw) -> Transformed:
    """The blocks of a text and its output."""
    breaks = np.flatnonzero(np.frombuffer(text, np.uint8) == 10)
    n = len(breaks) + (len(text) > 0 and not text.endswith(b"\n"))
    h1, h2, h3, h4 = draw.numbers(doc_id)
    if not text or any(s in text for s in SENTINELS) or h3 % 100 >= draw.transformed:
        return Transformed(n, PLAIN, b"", b"", text)
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    first, second = line_cut(text, breaks, first), line_cut(text, breaks, second)
    form = SPM if h4 % 100 < draw.spm else PSM
    buffer = bytearray(text)
    # From the back, so that the cuts before stay where they are.
    buffer[second:second] = SUFFIX
    buffer[first:first] = MIDDLE
    buffer[0:0] = PREFIX
    at_middle = len(PREFIX) + first
    at_suffix = len(PREFIX) + len(MIDDLE) + second
    view = np.frombuffer(buffer, np.uint8)
    rotate(view, at_middle if form == PSM else 0, at_suffix, len(buffer))
    return Transformed(n, form, text[:first], text[first:second], bytes(buffer))


def restore_text(output: bytes, form: str) -> bytes:
    """The text that ``output`` of this form was made of.

    A transformed text holds every sentinel once, so its blocks are found by
    them.  ``ValueError`` if one is missing or out of order.
    """
    if form == PLAIN:
        return output
    order = (PREFIX, SUFFIX, MIDDLE) if form == PSM else (SUFFIX, PREFIX, MIDDLE)
    places = [output.find(s) for s in order]
    if places[0] != 0 or sorted(places) != places:
        raise ValueError(f"no {form} output: sentinels at {places}")
    buffer = bytearray(output)
    view = np.frombuffer(buffer, np.uint8)
    size = len(output)
    if form == PSM:  # prefix, suffix, middle
        start, suffix = places[1], places[2] - places[1]
    else:  # suffix, prefix, middle
        start, suffix = 0, places[1]
    rotate(view, start, start + suffix, size)
    del view
    at_suffix = size - suffix
    at_middle = places[1] if form == PSM else places[2] - suffix
    for place, sentinel in ((at_suffix, SUFFIX), (at_middle, MIDDLE), (0, PREFIX)):
        del buffer[place : place + len(sentinel)]
    return bytes(buffer)


# --- tables -------------------------------------------------------------------------


def _bytes(column: pa.Array) -> Iterator[bytes]:
    for value in column:
        yield value.as_py() or b""


def transform(docs: DataFrame, draw: Draw = Draw()) -> DataFrame:
    """Add fim_lines, fim_form, fim_prefix_chars, fim_middle_chars and fim_text to ``docs`` (doc_id, text).

    A null text is empty.  Empty texts, texts that hold a sentinel and texts that
    the draw leaves out are ``plain``: their fim_text is the text, the two counts
    are null.  A null doc_id draws like an empty one; rows that repeat a doc_id
    have the same draw, each with its own lines.  Columns of the added names are
    replaced, all others kept.  One row per row.
    """
    added = ["fim_lines", "fim_form", "fim_prefix_chars", "fim_middle_chars", "fim_text"]
    docs = docs.drop(*added)
    names = docs.columns

    def transformed(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            texts = _bytes(batch.column("text").cast(pa.binary()))
            found = [transform_text(i, t, draw) for i, t in zip(ids, texts)]
            plain = [f.form == PLAIN for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([f.lines for f in found], pa.int64()),
                    pa.array([f.form for f in found], pa.string()),
                    pa.array([None if p else points(f.prefix) for f, p in zip(found, plain)], pa.int64()),
                    pa.array([None if p else points(f.middle) for f, p in zip(found, plain)], pa.int64()),
                    pa.array([f.output.decode() for f in found], pa.string()),
                ],
                [*names, *added],
            )

    kinds = ["bigint", "string", "bigint", "bigint", "string"]
    schema = docs.select("*", *[F.lit(None).cast(k).alias(c) for c, k in zip(added, kinds)]).schema
    return docs.mapInArrow(transformed, schema)


def restore(rows: DataFrame, text: str = "fim_text", form: str = "fim_form", into: str = "restored") -> DataFrame:
    """Add the text that ``text`` of the given ``form`` was made of; a null ``text`` gives null, a null form is plain.

    A row whose sentinels do not fit its form stops the job with its places.
    """
    rows = rows.drop(into)
    names = rows.columns

    def restored(batches):
        for batch in batches:
            outputs = batch.column(text).cast(pa.binary()).to_pylist()
            forms = batch.column(form).to_pylist()
            back = [None if o is None else restore_text(o, f or PLAIN).decode() for o, f in zip(outputs, forms)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.string())], [*names, into])

    return rows.mapInArrow(restored, rows.select("*", F.lit(None).cast("string").alias(into)).schema)


def report(docs: DataFrame, draw: Draw = Draw()) -> DataFrame:
    """Digests of every row's output and of the text restored from it.

    Returns doc_id, n (lines), form, prefix_chars, middle_chars (null if plain),
    output_sha256, restored_sha256.  Rows are treated as :func:`transform` says;
    texts do not leave the worker.
    """

    def digests(batches):
        for batch in batches:
            columns: list[list] = [[] for _ in range(6)]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), _bytes(batch.column("text"))):
                made = transform_text(doc_id, text, draw)
                plain = made.form == PLAIN
                row = (
                    made.lines,
                    made.form,
                    None if plain else points(made.prefix),
                    None if plain else points(made.middle),
                    hashlib.sha256(made.output).hexdigest(),
                    hashlib.sha256(restore_text(made.output, made.form)).hexdigest(),
                )
                for column, value in zip(columns, row):
                    column.append(value)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, columns, kinds)],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        digests,
        f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, "
        "output_sha256 string, restored_sha256 string",
    )


def report_sql(table: str = "documents") -> str:
    """The rows of the query in DuckDB SQL."""
    draw = Draw()
    number = "('0x' || substr(h, {0}, 8))::BIGINT"
    return f"""
WITH told AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{draw.seed}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM {table}),
cut AS (SELECT *, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS lines,
    text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR {number.format(17)} % 100 >= {draw.transformed} AS plain FROM told),
placed AS (SELECT *, len(lines) AS n, {number.format(1)} % (len(lines) + 1) AS a, {number.format(9)} % (len(lines) + 1) AS b FROM cut),
blocks AS (SELECT *, list_aggregate(lines[1:least(a, b)], 'string_agg', '') AS p, list_aggregate(lines[least(a, b) + 1:greatest(a, b)], 'string_agg', '') AS m,
    list_aggregate(lines[greatest(a, b) + 1:], 'string_agg', '') AS s FROM placed),
named AS (SELECT doc_id, n, text, CASE WHEN plain THEN 'plain' WHEN {number.format(25)} % 100 < {draw.spm} THEN 'spm' ELSE 'psm' END AS form,
    coalesce(p, '') AS p, coalesce(m, '') AS m, coalesce(s, '') AS s FROM blocks)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(text) AS restored_sha256 FROM named"""
