"""Near duplicates by circulant MinHash, banding and exact verification.

A first permutation scatters the shingles of a text over the cells of a table
that holds a second permutation; coordinate k of the signature is the smallest
entry of the second permutation shifted by k.  The entries of all shifts of a
cell lie side by side, so a signature is the minimum of short slices.

Texts with equal shingle sets form a class, and only one text of a class goes
on.  Bands of the signature make buckets.  Every bucket's members are compared
with its smallest one on their full sets.  Where the links found leave members
of a bucket in several components, all pairs across components are compared
too: small buckets list their pairs, large ones are compared block by block
inside tasks.  No pair whose link could join two components is left out.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import likely_in
from strata.llm.components import components, extended
from strata.llm.shingles import mix, shingle_set
from strata.session import lookup_join, written

# 64 bands of 6 coordinates miss a pair of similarity 0.75 with probability 4e-6.
BANDS = 64
ROWS = 6
PERCENT = 75

# Members of a bucket up to which its pairs are listed: at most half as many pairs per member.
# Larger buckets are compared in blocks of BLOCK texts.
DIRECT_MEMBERS = 32
BLOCK = 512

CELL_BITS = 20
_SLICE = 512


@lru_cache(maxsize=2)
def _shifts(coordinates: int) -> np.ndarray:
    """Row c holds entry c of the second permutation under every circular shift."""
    cells = np.arange(1 << CELL_BITS, dtype=np.uint64)
    second = np.empty(len(cells), np.uint32)
    second[np.argsort(mix(cells + np.uint64(1)), kind="stable")] = cells.astype(np.uint32)
    round_again = np.concatenate([second, second[:coordinates]])
    return np.lib.stride_tricks.sliding_window_view(round_again, coordinates)


def signature(distinct: np.ndarray, coordinates: int) -> np.ndarray:
    """All coordinates of the signature of a set of shingle hashes."""
    first = mix(distinct ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(64 - CELL_BITS)
    cells = first.astype(np.int64)
    shifts = _shifts(coordinates)
    lowest = np.full(coordinates, np.iinfo(np.uint32).max, np.uint32)
    for start in range(0, len(cells), _SLICE):
        np.minimum(lowest, shifts[cells[start : start + _SLICE]].min(axis=0), out=lowest)
    return lowest


def band_keys(lowest: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per band; the number of the band is part of it."""
    rows = lowest.reshape(bands, -1).astype(np.uint64)
    keys = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for column in rows.T:
        keys = mix(keys ^ column)
    return keys.view(np.int64)


def sketch(lowest: np.ndarray) -> np.ndarray:
    """The last bit of every coordinate, 64 in a number."""
    bits = np.packbits((lowest & 1).astype(np.uint8))
    return np.pad(bits, (0, -len(bits) % 8)).view(np.int64)


def _sets(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    coordinates = bands * rows

    def described(batches):
        for batch in batches:
            sizes, digests, keys, sketches = [], [], [], []
            for value in batch.column("text"):
                distinct = shingle_set(value.as_py())
                sizes.append(len(distinct))
                digests.append(hashlib.blake2b(distinct.tobytes(), digest_size=16).digest())
                lowest = signature(distinct, coordinates) if len(distinct) else None
                keys.append(None if lowest is None else band_keys(lowest, bands))
                sketches.append(None if lowest is None else sketch(lowest))
            numbers = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(keys, numbers),
                    pa.array(sketches, numbers),
                ],
                ["doc_id", "n_shingles", "digest", "bands", "sketch"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        described, "doc_id long, n_shingles long, digest binary, bands array<long>, sketch array<long>"
    )


def _least_agreeing(coordinates: int, percent: int) -> float:
    """Sketch bits that two texts of the least similarity share, less six standard deviations.

    Unrelated coordinates agree in half of their last bits.
    """
    agreeing = (1 + percent / 100) / 2
    return coordinates * agreeing - 6 * (coordinates * agreeing * (1 - agreeing)) ** 0.5


def _similar(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    both = np.intersect1d(one, other, assume_unique=True).size
    return 0 < both and 100 * both >= percent * (one.size + other.size - both)


def _may_link(coordinates: int, percent: int) -> Column:
    """Whether sizes and sketches of ``a`` and ``b`` allow the similarity."""
    words = -(-coordinates // 64)
    differing = sum(F.bit_count(F.col("a_sketch")[i].bitwiseXOR(F.col("b_sketch")[i])) for i in range(words))
    small, large = F.least("a_n", "b_n"), F.greatest("a_n", "b_n")
    return (small * 100 >= large * percent) & (F.lit(coordinates) - differing >= F.lit(_least_agreeing(coordinates, percent)))


def _described(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Add sizes and sketches of both ends."""
    ends = pairs.select(F.col("a").alias("v")).unionByName(pairs.select(F.col("b").alias("v"))).distinct()
    known = likely_in(sets.where("n_shingles > 0"), "doc_id", ends).select("doc_id", "n_shingles", "sketch")
    for end in ("a", "b"):
        side = known.select(
            F.col("doc_id").alias(f"__{end}"), F.col("n_shingles").alias(f"{end}_n"), F.col("sketch").alias(f"{end}_sketch")
        )
        pairs = pairs.join(side, F.col(end) == F.col(f"__{end}")).drop(f"__{end}")
    return pairs


def verified(pairs: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (``a``, ``b``) whose full shingle sets are similar enough.

    Texts are brought to the pairs by two joins on doc_id; the text of ``a``
    comes last, so it is not shuffled once per pair.  Where a doc_id has several
    texts, any of them may make the link.
    """
    ends = pairs.select(F.col("a").alias("v")).unionByName(pairs.select(F.col("b").alias("v"))).distinct()
    texts = likely_in(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", ends)
    right = texts.select(F.col("doc_id").alias("__b"), F.col("text").alias("b_text"))
    left = texts.select(F.col("doc_id").alias("__a"), F.col("text").alias("a_text"))
    joined = pairs.select("a", "b").join(right, F.col("b") == F.col("__b")).select("a", "b", "b_text")
    joined = joined.join(left, F.col("a") == F.col("__a")).select("a", "b", "a_text", "b_text")

    def linked(batches):
        last, own = None, None
        for batch in batches:
            keep = []
            for a_text, b_text in zip(batch.column("a_text"), batch.column("b_text")):
                a_text = a_text.as_py()
                if own is None or a_text != last:
                    last, own = a_text, shingle_set(a_text)
                other = shingle_set(b_text.as_py())
                keep.append(_similar(own, other, percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(linked, "a long, b long")


def _open_members(crowd: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (``key``, ``rep``, ``root``, ``n``) of the buckets whose ``n`` members lie in several components."""
    placed = crowd.select("key", "rep").join(roots, F.col("rep") == F.col("vertex"), "left")
    placed = placed.select("key", "rep", F.coalesce("root", "rep").alias("root"))
    placed = written(placed, "minhash-placed")
    spread = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n"))
    spread = spread.where("low < high").select("key", "n")
    return written(placed.join(spread, "key").select("key", "rep", "root", "n"), "minhash-open")


def _across(crowd: DataFrame, sets: DataFrame, coordinates: int, percent: int) -> DataFrame:
    """All pairs of a bucket's members in different components that sizes and sketches allow."""
    known = likely_in(sets.where("n_shingles > 0"), "doc_id", crowd.select("rep")).select("doc_id", "n_shingles", "sketch")
    inside = written(crowd.join(known, F.col("rep") == F.col("doc_id")).drop("doc_id"), "minhash-open")
    one = inside.select("key", *[F.col(c).alias(f"a{n}") for c, n in _SIDES])
    two = inside.select(F.col("key").alias("__key"), *[F.col(c).alias(f"b{n}") for c, n in _SIDES])
    apart = (F.col("key") == F.col("__key")) & (F.col("a") < F.col("b")) & (F.col("a_root") != F.col("b_root"))
    pairs = one.join(two, apart & _may_link(coordinates, percent)).select("a", "b").distinct()
    return written(pairs, "minhash-across")


def _blocks(many: DataFrame, block: int) -> DataFrame:
    """Members (``rep``, ``root``) of connected large buckets, once for every pair of blocks they belong to.

    Buckets that share members form a crowd, and a crowd is cut into blocks by a
    hash, so a pair of texts is compared once, in however many buckets it lies.
    """
    first = many.groupBy(F.col("key").alias("__key")).agg(F.min("rep").alias("first"))
    star = many.join(first, F.col("key") == F.col("__key")).select(F.col("first").alias("a"), F.col("rep").alias("b"))
    crowds = components(star).select(F.col("vertex").alias("__v"), F.col("root").alias("__crowd"))
    reps = many.select("rep", "root").distinct().join(crowds, F.col("rep") == F.col("__v"), "left")
    reps = written(reps.select("rep", "root", F.coalesce("__crowd", "rep").alias("crowd")), "minhash-crowds")
    sizes = reps.groupBy(F.col("crowd").alias("__c")).agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("n"))
    placed = reps.join(sizes, F.col("crowd") == F.col("__c")).drop("__c")
    placed = placed.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("n")).cast("int"))
    others = placed.select("rep", "root", "crowd", "own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    return others.select(
        "rep", "root", "crowd", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        (F.col("own") > F.col("other")).alias("second"),
    )


def _linked_in_blocks(
    many: DataFrame, sets: DataFrame, docs: DataFrame, coordinates: int, percent: int, block: int = BLOCK
) -> DataFrame:
    """Links between members of large buckets that lie in different components.

    A task holds the shingle sets of one block and passes the other block's
    texts by them, so its memory does not depend on the size of the crowd, and
    only links leave it.
    """
    parts = _blocks(many, block)
    reps = parts.select("rep").distinct()
    texts = likely_in(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", reps)
    known = likely_in(sets.where("n_shingles > 0"), "doc_id", reps).select(F.col("doc_id").alias("__d"), "n_shingles", "sketch")
    carried = texts.join(known, F.col("doc_id") == F.col("__d")).select("doc_id", "text", "n_shingles", "sketch")
    rows = parts.join(carried, F.col("rep") == F.col("doc_id")).drop("doc_id")
    order = ["crowd", "low", "high"]
    dealt = rows.repartition(*order).sortWithinPartitions(*order, "second", "rep")
    least_bits, width = _least_agreeing(coordinates, percent), -(-coordinates // 64)

    def linked(batches):
        at, ids, held_roots, held_sizes, held_sets = None, [], [], [], []
        held_bits = np.empty((0, width), np.uint64)
        for batch in batches:
            out_a, out_b = [], []
            columns = [batch.column(c) for c in (*order, "second", "rep", "root", "n_shingles", "sketch", "text")]
            for crowd, low, high, second, rep, root, size, bits, text in zip(*columns):
                group = (crowd.as_py(), low.as_py(), high.as_py())
                if group != at:
                    at, ids, held_roots, held_sizes, held_sets = group, [], [], [], []
                    held_bits = np.empty((64, width), np.uint64)
                rep, root, size, n = rep.as_py(), root.as_py(), size.as_py(), len(ids)
                bits = np.array(bits.as_py(), np.int64).view(np.uint64)
                own = shingle_set(text.as_py())
                inner = group[1] == group[2]
                if n and (second.as_py() or inner):
                    differing = np.bitwise_count(held_bits[:n] ^ bits).sum(axis=1)
                    sizes = np.array(held_sizes)
                    likely = (coordinates - differing.astype(np.int64) >= least_bits) & (np.array(held_roots) != root)
                    likely &= np.minimum(sizes, size) * 100 >= np.maximum(sizes, size) * percent
                    for i in np.flatnonzero(likely):
                        if _similar(held_sets[i], own, percent):
                            out_a.append(ids[i])
                            out_b.append(rep)
                if not second.as_py():
                    if n == len(held_bits):
                        held_bits = np.concatenate([held_bits, np.empty_like(held_bits)])
                    held_bits[n] = bits
                    ids.append(rep)
                    held_roots.append(root)
                    held_sizes.append(size)
                    held_sets.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return dealt.mapInArrow(linked, "a long, b long")


_SIDES = (("rep", ""), ("root", "_root"), ("n_shingles", "_n"), ("sketch", "_sketch"))


def near_duplicates(
    docs: DataFrame, bands: int = BANDS, rows: int = ROWS, percent: int = PERCENT
) -> DataFrame:
    """Components of near-duplicate texts: one row per row of ``docs`` (doc_id, text).

    Returns doc_id, n_shingles, component_id, kept.  Two texts are linked if 100
    times the intersection of their shingle sets is at least ``percent`` times
    the union.  component_id is the smallest doc_id that links reach.
    Null and empty texts have no shingles and are linked with nothing; neither
    are rows without doc_id, which are kept and have no component_id.  Rows that
    repeat a doc_id are compared like others, and their component is the smallest
    doc_id all the same.  An empty table gives no rows.
    """
    coordinates = bands * rows
    sets = written(_sets(docs, bands, rows), "minhash-sets")
    named = sets.where("n_shingles > 0 and doc_id is not null")
    classes = written(
        named.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "minhash-classes"
    )
    first = classes.select("rep", F.col("digest").alias("__digest"))
    reps = named.join(first, (F.col("doc_id") == F.col("rep")) & (F.col("digest") == F.col("__digest")))
    keyed = written(reps.select(F.explode("bands").alias("key"), "rep"), "minhash-keys")

    buckets = keyed.groupBy("key").agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("size"))
    buckets = written(buckets.where("size > 1"), "minhash-buckets")
    near = likely_in(keyed, "key", buckets.select("key"))
    members = written(near.join(buckets, "key").select("key", "rep", "leader", "size"), "minhash-members")

    def confirmed(pairs: DataFrame) -> DataFrame:
        likely = _described(pairs.distinct(), sets).where(_may_link(coordinates, percent))
        return written(verified(written(likely.select("a", "b").distinct(), "minhash-pairs"), docs, percent), "minhash-links")

    star = members.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b"))
    roots = components(confirmed(star))
    crowd = _open_members(members.where("size > 2"), roots)
    few = crowd.where(F.col("n") <= DIRECT_MEMBERS).drop("n")
    roots = extended(roots, written(verified(_across(few, sets, coordinates, percent), docs, percent), "minhash-links"))
    many = _open_members(crowd.where(F.col("n") > DIRECT_MEMBERS), roots).drop("n")
    if many.limit(1).count():
        roots = extended(roots, written(_linked_in_blocks(many, sets, docs, coordinates, percent), "minhash-links"))

    dim = (
        classes.join(roots, F.col("rep") == F.col("vertex"), "left")
        .select("digest", "copies", F.coalesce("root", "rep").alias("component_id"), F.col("root").isNotNull().alias("moved"))
        .where("copies > 1 or moved")
        .drop("moved")
    )
    dim = written(dim, "minhash-components")
    facts = sets.select("doc_id", "n_shingles", "digest")
    joined = lookup_join(facts, dim, ["digest"], "copies", "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return joined.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        component.eqNullSafe(F.col("doc_id")).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    Of rows that repeat a doc_id one stays; all rows without doc_id stay, and so
    do null and empty texts, which are linked with nothing.
    """
    found = near_duplicates(docs, **options)
    found = found.where("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(
        F.max("kept").alias("__kept"), (F.count(F.lit(1)) > 1).alias("__repeated")
    )
    rows = docs.join(found, F.col("doc_id") == F.col("__id"), "left").where("__kept or __kept is null")
    once = rows.where("not coalesce(__repeated, false)").select(*docs.columns)
    again = rows.where("__repeated").dropDuplicates(["__id"]).select(*docs.columns)
    return once.unionByName(again)


def near_sql(table: str = "documents") -> str:
    """The rows of the query in DuckDB SQL, by counting the shingles that any two documents share."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE told AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM {table}),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM told),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
held AS (SELECT doc_id, unnest(s) AS x FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM held a JOIN held b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * shared >= {PERCENT} * (p.n + q.n - shared)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM sizes UNION SELECT r.doc_id, w.b FROM reach r JOIN ways w ON w.a = r.other)
SELECT s.doc_id, any_value(s.n) AS n_shingles, min(other) AS component_id, min(other) = s.doc_id AS kept
FROM sizes s JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id"""
