import re

import numpy as np
from pyspark.sql import functions as F

from strata.llm import mixing


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes):
    """Shares with the excess reshared by weight until no target is above its stop."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    budget, full = 1.5 * sum(sizes.values()), {}
    while True:
        open_names = [s for s in names if s not in full]
        rest = budget - sum(full.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_names) for s in open_names}
        over = [s for s in open_names if share[s] >= 2 * sizes[s]]
        if not over:
            return {**full, **share}
        full |= {s: 2.0 * sizes[s] for s in over}


def made(n=3000):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(n):
        source = ["a", "B", "é", "\U0001f525", "zz", "", None, "hot"][min(7, int(rng.integers(0, 12)))]
        text = None if i % 97 == 0 else " ".join(["w"] * int(rng.integers(0, 40))) + "\t\x0b"
        rows.append((i, text, source, i))
    return rows + [(5, rows[5][1], rows[5][2], 5), (None, "one two", "a", 1), (None, "one two", "a", 1)]


def test_targets_and_shares_equal_brute_force(spark):
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long").repartition(5)
    got = mixing.mix(docs).collect()
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), size(t)) for i, t, _, _ in rows)
    sizes = {}
    for _, text, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + size(text)
    want, taken = brute_targets(sizes), {}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for source, words in taken.items():
        assert abs(words - want[source]) <= 80  # two of the largest documents, as repeated rows go together
    again = mixing.mix(docs.repartition(2)).collect()
    assert sorted((str(r.doc_id), r.taken) for r in got) == sorted((str(r.doc_id), r.taken) for r in again)
    out = mixing.repeated(docs)
    assert out.columns == docs.columns
    assert sum(size(r.text) for r in out.collect()) == sum(taken.values())


def test_small_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "", "x")], "doc_id long, text string, source string")
    assert sorted((r.size, r.target, r.taken) for r in mixing.mix(docs).collect()) == [(0, 0.0, 0)] * 2
    assert mixing.mix(docs.limit(0)).collect() == []
    one = spark.createDataFrame([(1, "a b c d", "x")], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mixing.mix(one).collect()] == [(6.0, 8)]
    skewed = spark.createDataFrame([(1, "a " * 50_000, "x"), (2, "b", "y")], "doc_id long, text string, source string")
    assert sum(r.taken for r in mixing.mix(skewed).collect()) <= 100_002


def test_null_repeated_and_equal_ids_come_near_their_targets(spark):
    rows = [(i, f"text {i} of ten words in all and no more", "a") for i in range(300)]
    rows += [(None, f"text {i} of ten words in all and no more", "b") for i in range(300)]
    rows += [(7, f"text {i} of ten words in all and no more", "c") for i in range(300)]
    rows += [(8, "always the same text of nine words or so", "d")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("__times", F.lit(1)).repartition(6)
    taken, target = {}, {}
    for r in mixing.mix(docs).collect():
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    out = mixing.repeated(docs)
    assert out.columns == docs.columns
    kept = {}
    for r in out.collect():
        kept[r.source] = kept.get(r.source, 0) + size(r.text)
    assert kept == taken
    for source, words in taken.items():
        assert abs(words - target[source]) <= 10, source
    assert mixing.repeated(docs.limit(0)).count() == 0
