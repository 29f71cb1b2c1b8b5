"""Alignment of two tokenizers over the same bytes, by divide and conquer at shared cuts.

Both token lists of a text cover the same bytes, so a list is its token ends, in
ascending order.  An interval of both lists is divided at an end that both have:
starting from the middle token and going outwards, ends are looked up in the
other list by bisection.  Both halves are divided in the same way; an interval
without a shared inner end is a leaf, a group of tokens that belong together.
All intervals of some texts are divided in step, level by level.

The first tokenizer is a byte-level vocabulary whose ids follow the order of its
merges; such a one is its ranks, so whole texts are encoded by the faster of two
libraries that give the same ids.

How many documents hold a linked pair of ids is counted over all documents.
The counts reach the documents in two ways: pairs with a fixed share of all
rows, of which there is a bounded number, as a broadcast table, all others by a
join, in which no pair can have more than that share of the rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.bpe import WHITE_SPACE, byte_characters
from strata.llm.worker import held
from strata.session import written

# Characters of the texts that are aligned at once; a longer text is by itself.
BATCH_CHARS = 500_000
# Links of a group that are listed one by one; larger groups are counted by id.
LISTED_LINKS = 4096
# Different pairs that a task counts before it hands them on.
COUNTED_PAIRS = 1 << 20
# A pair with 1/HOT_PARTS of all (document, pair) rows is broadcast: at most HOT_PARTS pairs.
HOT_PARTS = 1 << 18

# The sign that stands for a space in a piece vocabulary (fixed value).
SPACE_SIGN = "▁"
# White space that is too long for a backtracking pattern; the other library has no such limit.
_LONG_BLANK = re.compile(r"\s{10000}")


def shared_cuts(
    a: np.ndarray, b: np.ndarray, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Whether a token is the last of its group, for both lists of token ends.

    ``a`` and ``b`` ascend; interval n holds the tokens ``a0[n] .. a1[n] - 1`` and
    ``b0[n] .. b1[n] - 1``, which end at the same byte.  All intervals are divided
    at once.  Those whose middle token ends at no shared place look further in
    steps that double, so an interval without cuts is read through once.
    """
    last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    last_a[a1 - 1] = last_b[b1 - 1] = True
    step = np.zeros(len(a0), np.int64)
    while True:
        open_ = (a1 - a0 > 1) & (b1 - b0 > 1)
        a0, a1, b0, b1, step = (v[open_] for v in (a0, a1, b0, b1, step))
        if not len(a0):
            return last_a, last_b
        middle = (a0 + a1 - 1) >> 1
        # Tokens at distances 2^step - 1 to 2^(step+1) - 2 from the middle, the nearest first.
        width = 2 << step
        of = np.repeat(np.arange(len(a0)), width)
        within = np.arange(len(of)) - np.repeat(np.cumsum(width) - width, width)
        away = (1 << step)[of] - 1 + (within >> 1)
        i = middle[of] + np.where(within & 1, -away, away)
        # The last token's end is the end of the interval, so it is no inner end.
        inside = (i >= a0[of]) & (i < a1[of] - 1)
        of, i = of[inside], i[inside]
        j = np.searchsorted(b, a[i])
        same = (j < b1[of] - 1) & (b[np.minimum(j, len(b) - 1)] == a[i])
        found, first = np.unique(of[same], return_index=True)
        i, j = i[same][first], j[same][first]
        last_a[i] = last_b[j] = True
        on = np.ones(len(a0), bool)
        on[found] = False
        on &= (2 << step) - 1 <= np.maximum(a1 - 1 - middle, middle - a0)  # else it is a leaf
        new = np.zeros(len(found), np.int64)
        a0, a1, b0, b1, step = (
            np.concatenate(parts)
            for parts in (
                (a0[on], a0[found], i + 1),
                (a1[on], i + 1, a1[found]),
                (b0[on], b0[found], j + 1),
                (b1[on], j + 1, b1[found]),
                (step[on] + 1, new, new),
            )
        )


@dataclass(frozen=True)
class Tokenizers:
    """A byte-level tokenizer as the tokenizers library stores it with its pattern, and a piece model of sentencepiece."""

    first: str
    second: bytes
    pattern: str

    def width(self) -> int:
        """Size of the second vocabulary."""
        from sentencepiece import SentencePieceProcessor

        return SentencePieceProcessor(model_proto=self.second).vocab_size()


def tokenizers(first_path: str, second_path: str, pattern: str) -> Tokenizers:
    with open(first_path, encoding="utf-8") as first, open(second_path, "rb") as second:
        return Tokenizers(first.read(), second.read(), pattern)


# Ids of a text by both tokenizers; none if it is empty or one of them does not give it back.
Ids = tuple[list[int], list[int]] | None


@dataclass
class Aligned:
    """Some texts, one after the other: ids of both tokenizers, and the group of every token."""

    a: np.ndarray
    b: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    a_start: np.ndarray  # first token of every text, and the end
    b_start: np.ndarray
    a_ends: np.ndarray  # in bytes, counted from the first text
    b_ends: np.ndarray


class Aligner:
    """Both tokenizers; one per worker."""

    def __init__(self, stored: Tokenizers):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        import tiktoken
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_str(stored.first)
        self.first.encode_special_tokens = True  # their strings in a text are plain text
        self.second = SentencePieceProcessor(model_proto=stored.second)
        back = {c: b for b, c in enumerate(byte_characters())}
        model = json.loads(stored.first)["model"]
        self.first_bytes = {i: bytes(back[c] for c in t) for t, i in model["vocab"].items()}
        self.second_bytes = [self._second_bytes(i) for i in range(self.second.vocab_size())]
        self.first_sizes = np.zeros(max(self.first_bytes) + 1, np.int64)
        for i, told in self.first_bytes.items():
            self.first_sizes[i] = len(told)
        self.second_sizes = np.array(list(map(len, self.second_bytes)), np.int64)
        ids = range(len(self.first_sizes)), range(len(self.second_sizes))
        self.signs = [b"%d%c" % (i, mark) for own, marks in zip(ids, (b",|", b",;")) for i in own for mark in marks]
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        self.ranked = None
        if merged == sorted(merged) and not model.get("ignore_merges"):  # ids follow the order of the merges
            ranks = {told: i for i, told in self.first_bytes.items()}
            self.ranked = tiktoken.Encoding("first", pat_str=stored.pattern, mergeable_ranks=ranks, special_tokens={})

    def _second_bytes(self, i: int) -> bytes:
        piece = self.second.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if self.second.is_byte(i) else piece.replace(SPACE_SIGN, " ").encode()

    def _first_ids(self, text: str) -> list[int]:
        if self.ranked is None or (len(text) > 10_000 and _LONG_BLANK.search(text)):
            return self.first.encode(text, add_special_tokens=False).ids
        return self.ranked.encode_ordinary(text)

    def _first_told(self, ids: list[int]) -> bytes:
        return self.ranked.decode_bytes(ids) if self.ranked else b"".join(map(self.first_bytes.__getitem__, ids))

    def ids(self, text: str) -> Ids:
        """Ids of a space and ``text``; the second tokenizer adds the space."""
        if not text:
            return None
        a, b = self._first_ids(" " + text), self.second.encode(text, num_threads=1)
        told = (" " + text).encode()
        whole = self._first_told(a) == told == b"".join(map(self.second_bytes.__getitem__, b))
        return (a, b) if whole else None

    def align(self, texts: list[tuple[list[int], list[int]]]) -> Aligned:
        """Groups of texts given by their ids."""
        a_lists, b_lists = zip(*texts) if texts else ((), ())
        a_start, b_start = (np.cumsum([0, *map(len, v)]) for v in (a_lists, b_lists))
        a = np.fromiter(chain.from_iterable(a_lists), np.int64, a_start[-1])
        b = np.fromiter(chain.from_iterable(b_lists), np.int64, b_start[-1])
        a_ends, b_ends = np.cumsum(self.first_sizes[a]), np.cumsum(self.second_sizes[b])
        last_a, last_b = shared_cuts(a_ends, b_ends, a_start[:-1], a_start[1:], b_start[:-1], b_start[1:])
        return Aligned(a, b, np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b, a_start, b_start, a_ends, b_ends)

    def groups(self, text: str) -> list[tuple[int, int, list[int], list[int]]]:
        """Groups of a space and ``text``: first and last (exclusive) byte, ids of both tokenizers."""
        ids = self.ids(text)
        if ids is None:
            return []
        found = self.align([ids])
        n = np.arange(found.a_group[-1] + 2)
        a_at, b_at = np.searchsorted(found.a_group, n), np.searchsorted(found.b_group, n)
        ends = np.concatenate([[0], found.a_ends[a_at[1:] - 1]])
        return [
            (int(ends[g]), int(ends[g + 1]), found.a[a_at[g] : a_at[g + 1]].tolist(), found.b[b_at[g] : b_at[g + 1]].tolist())
            for g in n[:-1]
        ]

    def shown(self, found: Aligned) -> list[bytes]:
        """The groups of every text in digits, as the data contract prints them."""
        groups = int(found.a_group[-1]) + 1 if len(found.a_group) else 0
        a_before = np.searchsorted(found.a_group, np.arange(groups + 1))
        b_before = np.searchsorted(found.b_group, np.arange(groups + 1))
        # Tokens in printed order, each with the sign after it.
        codes = np.empty(len(found.a) + len(found.b), np.int64)
        a_last = np.arange(len(found.a)) == a_before[found.a_group + 1] - 1
        b_last = np.arange(len(found.b)) == b_before[found.b_group + 1] - 1
        codes[np.arange(len(found.a)) + b_before[found.a_group]] = 2 * found.a + a_last
        codes[np.arange(len(found.b)) + a_before[found.b_group + 1]] = 2 * (len(self.first_sizes) + found.b) + b_last
        told = list(map(self.signs.__getitem__, codes.tolist()))
        at = (found.a_start + found.b_start).tolist()
        return [b"".join(told[i:j])[:-1] for i, j in zip(at, at[1:])]

    def links(self, found: Aligned) -> list[tuple[np.ndarray, np.ndarray]]:
        """Keys of the different links of every text, ascending, and how often each occurs."""
        width, n_texts = len(self.second_sizes), len(found.a_start) - 1
        groups = int(found.a_group[-1]) + 1 if len(found.a_group) else 0
        n_a, n_b = np.bincount(found.a_group, minlength=groups), np.bincount(found.b_group, minlength=groups)
        b_at = np.cumsum(n_b) - n_b
        listed = (n_a * n_b <= LISTED_LINKS)[found.a_group]
        a_group = found.a_group[listed]
        times = n_b[a_group]
        text = np.searchsorted(found.a_start, np.flatnonzero(listed), side="right") - 1
        right = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(b_at[a_group], times)
        keys = np.repeat(found.a[listed], times) * width + found.b[right]
        space = width * len(self.first_sizes)
        distinct, counts = np.unique(np.repeat(text, times) * space + keys, return_counts=True)
        for g in np.flatnonzero(n_a * n_b > LISTED_LINKS).tolist():  # counted by id
            at = int(np.searchsorted(found.a_group, g))
            a_ids, a_n = np.unique(found.a[at : at + n_a[g]], return_counts=True)
            b_ids, b_n = np.unique(found.b[b_at[g] : b_at[g] + n_b[g]], return_counts=True)
            base = (int(np.searchsorted(found.a_start, at, side="right")) - 1) * space
            more = (base + a_ids[:, None] * width + b_ids[None, :]).ravel()
            distinct, place = np.unique(np.concatenate([distinct, more]), return_inverse=True)
            weights = np.concatenate([counts, (a_n[:, None] * b_n[None, :]).ravel()])
            counts = np.bincount(place, weights=weights, minlength=len(distinct)).astype(np.int64)
        cuts = np.searchsorted(distinct, np.arange(n_texts + 1) * space)
        return [(distinct[i:j] % space, counts[i:j]) for i, j in zip(cuts, cuts[1:])]


def aligner(stored: Tokenizers) -> Aligner:
    """The worker's aligner of two stored tokenizers."""
    return held("align", stored, lambda: Aligner(stored))


def align(docs: DataFrame, stored: Tokenizers, into: str = "token_groups") -> DataFrame:
    """Add the groups of every row's text: first_byte, last_byte (exclusive, of a space and the text), first_ids, second_ids.

    Null and empty texts, and texts that a tokenizer does not give back byte by
    byte, have no groups.  A column named ``into`` is replaced, all others are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(stored)
    docs = docs.drop(into)
    names = docs.columns
    fields = {"first_byte": "int", "last_byte": "int", "first_ids": "array<int>", "second_ids": "array<int>"}
    kind = "array<struct<" + ",".join(f"{n}:{k}" for n, k in fields.items()) + ">>"

    def aligned(batches):
        own = aligner(shared.value)
        ints = pa.list_(pa.int32())
        shape = pa.list_(pa.struct(list(zip(fields, (pa.int32(), pa.int32(), ints, ints)))))
        for batch in batches:
            told = [[dict(zip(fields, g)) for g in own.groups(v.as_py() or "")] for v in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(told, shape)], [*names, into])

    return docs.mapInArrow(aligned, docs.select("*", F.lit(None).cast(kind).alias(into)).schema)


_LINKED = {
    "n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "groups_sha256": "string",
    "keys": "array<bigint>", "times": "array<bigint>",
}


def linked(docs: DataFrame, stored: Tokenizers) -> DataFrame:
    """Counts, digest and links of every row: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, keys, times.

    ``keys`` are the different linked pairs (first id times the size of the
    second vocabulary, plus second id), ascending; ``times`` says how often each
    is linked.  Texts are read once, one by one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(stored)
    longs = pa.list_(pa.int64())
    kinds = [*[pa.int64()] * 4, pa.string(), longs, longs]

    def rows(batches):
        own = aligner(shared.value)
        def told(texts):
            """Rows of some texts, given by their ids."""
            whole = [t for t in texts if t is not None]
            found = own.align(whole)
            full = zip(own.shown(found), own.links(found), np.diff(found.a_start), np.diff(found.b_start))
            for text in texts:
                if text is None:
                    yield 0, 0, 0, 0, "", [], []
                else:
                    shown, (keys, times), n_a, n_b = next(full)
                    yield n_a, n_b, shown.count(b"|"), times.sum(), hashlib.sha256(shown).hexdigest(), keys, times

        for batch in batches:
            columns: list[list] = [[] for _ in kinds]
            waiting, n = [], 0
            for value in chain(batch.column("text"), [None]):
                if value is not None:
                    text = value.as_py() or ""
                    waiting.append(own.ids(text))
                    n += len(text)
                if n > BATCH_CHARS or value is None:
                    for row in told(waiting):
                        for column, cell in zip(columns, row):
                            column.append(cell)
                    waiting, n = [], 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, columns, kinds)], ["doc_id", *_LINKED]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{c} {k}" for c, k in _LINKED.items())
    return docs.select("doc_id", "text").mapInArrow(rows, schema)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column and the lengths of its lists."""
    return lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)


def pair_counts(rows: DataFrame) -> DataFrame:
    """How many rows of :func:`linked` hold a key: key, n.

    Counted inside the tasks first; a task holds at most ``COUNTED_PAIRS`` pairs
    and one batch before it hands them on.
    """

    def counted(batches):
        keys, times = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            new = _flat(batch.column("keys"))[0]
            distinct, place = np.unique(np.concatenate([keys, new]), return_inverse=True)
            weights = np.concatenate([times, np.ones(len(new), np.int64)])
            keys, times = distinct, np.bincount(place, weights=weights, minlength=len(distinct)).astype(np.int64)
            if len(keys) > COUNTED_PAIRS:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(times)], ["key", "n"])
                keys, times = keys[:0], times[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(times)], ["key", "n"])

    parts = rows.select("keys").mapInArrow(counted, "key bigint, n bigint")
    return parts.groupBy("key").agg(F.sum("n").alias("n"))


def rated_pairs(counts: DataFrame, width: int) -> DataFrame:
    """Add ``best``: whether no pair of the same first id has a higher count.

    The highest counts are one row for each id of the first tokenizer: its
    vocabulary bounds the table that is broadcast.
    """
    first = F.floor(F.col("key") / width).cast("int")
    highest = counts.groupBy(first.alias("first_id")).agg(F.max("n").alias("most"))
    rated = counts.withColumn("first_id", first).join(F.broadcast(highest), "first_id")
    return rated.select("key", "n", (F.col("n") == F.col("most")).alias("best"))


def report(docs: DataFrame, stored: Tokenizers, hot_parts: int = HOT_PARTS) -> DataFrame:
    """Alignment of every row of ``docs`` (doc_id, text) as counts and a digest.

    Returns doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair has the
    highest count of its first id), count_sum (sum of the counts over the links),
    groups_sha256.  A pair's count is the number of rows that link it; every row
    counts, also one that repeats a doc_id or a text.  Null and empty texts, and
    texts that a tokenizer does not give back, have zeros and an empty digest.
    Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    # Stored, so that texts are tokenized once and a row's number is decided once.
    rows = linked(docs, stored).withColumn("row", F.monotonically_increasing_id())
    rows = written(rows, "link-rows")
    counts = written(pair_counts(rows), "link-counts")
    rated = rated_pairs(counts, stored.width())
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    is_hot = F.col("n") * F.lit(hot_parts) >= F.lit(total)
    hot = rated.where(is_hot).toArrow()
    order = np.argsort(hot["key"].to_numpy(), kind="stable")
    table = spark.sparkContext.broadcast(
        (hot["key"].to_numpy()[order], hot["n"].to_numpy()[order], hot["best"].to_numpy().astype(bool)[order])
    )

    def looked_up(batches):
        """Sums over the pairs of the table, and the other pairs of every row."""
        known, n_known, best_known = table.value
        for batch in batches:
            keys, lengths = _flat(batch.column("keys"))
            times, _ = _flat(batch.column("times"))
            owner = np.repeat(np.arange(len(lengths)), lengths)
            at = np.searchsorted(known, keys)
            seen = at < len(known)
            seen[seen] = known[at[seen]] == keys[seen]
            at, mine, n = at[seen], owner[seen], times[seen]
            best, total = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            np.add.at(best, mine, n * best_known[at])
            np.add.at(total, mine, n * n_known[at])
            offsets = np.concatenate([[0], np.cumsum(np.bincount(owner[~seen], minlength=len(lengths)))]).astype(np.int32)
            others = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(v[~seen])) for v in (keys, times)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(best), pa.array(total), *others], ["row", "best", "total", "keys", "times"]
            )

    sums = rows.select("row", "keys", "times").mapInArrow(
        looked_up, "row bigint, best bigint, total bigint, keys array<bigint>, times array<bigint>"
    )
    sums = written(sums, "link-sums")
    other = sums.select("row", F.explode(F.arrays_zip("keys", "times")).alias("l")).select("row", "l.keys", "l.times")
    joined = other.withColumnRenamed("keys", "key").join(rated.where(~is_hot), "key")
    more = joined.select(
        "row", F.when(F.col("best"), F.col("times")).otherwise(0).alias("best"), (F.col("times") * F.col("n")).alias("total")
    )
    whole = sums.select("row", "best", "total").unionByName(more).groupBy("row").agg(
        F.sum("best").alias("n_best"), F.sum("total").alias("count_sum")
    )
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return rows.drop("keys", "times").join(whole, "row").select(*columns)
