import zlib

import numpy as np

from strata.llm import sharding


def brute(rows, n):
    ordered = sorted(((i is not None, i or 0), zlib.crc32((t or "").encode()), len((t or "").encode()) + 8, i) for i, t, _ in rows)
    total, upto, slots, out = sum(r[2] for r in ordered), 0, {}, []
    for _, crc, size, i in ordered:
        shard = (2 * upto + size) * n // (2 * total)
        upto += size
        out.append((str(i), size, crc, shard, slots.setdefault(shard, 0)))
        slots[shard] += 1
    return sorted(out)


def test_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), "é" * int(rng.integers(0, 200)), "x") for i in rng.permutation(2000)]
    rows += [(3, "same", "x"), (3, "same", "x"), (None, None, None), (None, "b", None), (2500, "long " * 20_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string").repartition(6)
    for n, partitions in ((24, None), (5, 3), (1, 1), (24, 50)):
        got = sharding.shards(docs, n, partitions).collect()
        assert sorted((str(r.doc_id), r.size, r.text_crc32, r.shard, r.slot) for r in got) == brute(rows, n)
        assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    assert sharding.shards(docs.limit(0)).collect() == []


def test_given_documents_are_balanced(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sharding.shards(docs).collect()
    sums = np.bincount([r.shard for r in got], weights=[r.size for r in got], minlength=24)
    assert len(sums) == 24 and sums.max() - sums.min() <= 2 * max(r.size for r in got)
    for shard in range(24):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
