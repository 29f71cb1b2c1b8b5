import hashlib

import numpy as np
from pyspark.sql import functions as F

from strata.llm import common, exact_dedup


def body(text):
    return "".join(c for c in text or "" if c not in common.WHITE)


def brute(rows):
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(body(t), []).append((-len(t or ""), i is None, i if i is not None else 0, i))
    out = []
    for i, t, _ in rows:
        best = min(groups[body(t)])
        sha = hashlib.sha256(body(t).encode()).hexdigest()
        out.append((str(i), str(best[3]), len(groups[body(t)]), (i == best[3]) and -len(t or "") == best[0], sha))
    return sorted(out)


def made():
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(["a", "b", "é", "\U0001f525"], int(rng.integers(1, 6)))) for _ in range(600)]
    texts += ["hot copy"] * 300 + ["hot\tcopy \n"] * 3 + ["hot copy "] * 2 + ["", None, " \x0b", " ", "x" * 50_000, "x" * 50_000]
    return [(int(i), t, "k") for i, t in zip(rng.permutation(len(texts)) * 7 - 900, texts)]


def rows_of(df):
    return sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in df.collect())


def test_equals_brute_force(spark):
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(7)
    for capacity in (4096, 3):
        assert rows_of(exact_dedup.exact_groups(docs, capacity)) == brute(rows)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(r[0] for r in brute(rows) if r[3])


def test_odd_rows(spark):
    rows = [(None, "a b", "x"), (None, "ab", "x"), (4, "ab", "x"), (4, "ab", "x"), (9, None, "x"), (2**62, "", None), (-(2**62), " c", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, group_size string")
    assert rows_of(exact_dedup.exact_groups(docs)) == brute(rows)
    assert exact_dedup.exact_groups(docs.limit(0)).collect() == []
    same = spark.createDataFrame([(4, "ab"), (4, "ab"), (4, "a")], "doc_id long, text string")
    assert sorted(r.text for r in exact_dedup.drop_copies(same).collect()) == ["a", "ab"]


def test_texts_under_one_key_are_compared_byte_by_byte(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "_key", lambda text: F.length(text).cast("long"))
    rows = made()[:400]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    assert rows_of(exact_dedup.exact_groups(docs)) == brute(rows)


def test_directory_splits_full_buckets_only(spark):
    cells = spark.createDataFrame([(c, 5) for c in range(0, 2000)] + [(60_000, 1)], "cell int, keys long")
    got = exact_dedup.directory(cells, 100).collect()
    assert sorted(r.cell for r in got) == list(range(1 << exact_dedup.DIRECTORY_BITS))
    by_cell = {r.cell: r for r in got}
    counts = {}
    for c in range(2000):
        counts[by_cell[c].bucket] = counts.get(by_cell[c].bucket, 0) + 5
    assert max(counts.values()) <= 100
    assert by_cell[60_000].depth == 1
    assert {r.bucket for r in exact_dedup.directory(cells.limit(3), 100).collect()} == {0}
    assert len(exact_dedup.directory(cells.limit(0), 100).collect()) == 1 << exact_dedup.DIRECTORY_BITS


def test_bounded_filter_loses_no_key(spark):
    rows = spark.range(5000).select(F.col("id").alias("k"))
    keys = spark.range(0, 5000, 7)
    kept = common.likely_in(rows, "k", keys)
    assert kept.columns == ["k"]
    got = {r.k for r in kept.collect()}
    assert set(range(0, 5000, 7)) <= got and len(got) < 1000
