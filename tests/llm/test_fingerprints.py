import hashlib

import numpy as np

from strata.llm import fingerprints as fp
from strata.llm.shingles import shingle_set


def texts():
    rng = np.random.default_rng(11)
    made = [" ".join(rng.choice([f"w{i}" for i in range(400)], int(rng.integers(1, 400)))) for _ in range(60)]
    return [*made, "", "", None, "x", "é\U0001f525" * 50, made[0], made[0] + " tail", "long " * 30_000]


def test_rows_equal_brute_force(spark):
    rows = [(i * 3, t, "x") for i, t in enumerate(texts())] + [(3, "again a row", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string").repartition(4)
    ordered = sorted((i, t or "") for i, t, _ in rows)
    want = {}
    for k, (i, text) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        n = len(text) // 4
        changed = text[: len(text) - n] + following[:n]
        want[i, text] = (changed, following)
    for parts in (1, 7, 200):
        got = fp.neighbours(docs, partitions=parts).collect()
        assert len(got) == len(rows)
        by_id = {}
        for (i, text), (changed, following) in want.items():
            by_id.setdefault(i, []).append((len(text), hashlib.sha256(changed.encode()).hexdigest(), fp.pack(np.sort(shingle_set(text))[: fp.K])))
        for r in got:
            assert (r.n_chars, r.edited_sha256, r.fingerprint) in by_id[r.doc_id]
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def test_estimates():
    rng = np.random.default_rng(2)
    wrong, sizes, inside = [], [], []
    for _ in range(40):
        pool = [f"v{i}" for i in rng.permutation(20_000)]
        a, b = " ".join(pool[:3000]), " ".join(pool[:1500] + pool[4000:5500])
        sa, sb = set(shingle_set(a).tolist()), set(shingle_set(b).tolist())
        wrong.append(fp.resemblance(fp.sketch(a), fp.sketch(b)) - len(sa & sb) / len(sa | sb))
        inside.append(fp.containment(fp.sketch(a), fp.sketch(b)) - len(sa & sb) / len(sa))
        sizes.append(fp.distinct(fp.sketch(a)) / len(sa))
    assert abs(np.mean(wrong)) < 0.03 and np.std(wrong) < 0.06
    assert abs(np.mean(inside)) < 0.05
    assert abs(np.mean(sizes) - 1) < 0.05
    empty = fp.sketch("")
    assert fp.resemblance(empty, empty) == 1 and fp.resemblance(empty, fp.sketch("a")) == 0


def test_merging_parts_is_sketching_the_whole(spark):
    made = [t for t in texts() if t]
    rows = [(i % 3 if i % 4 else None, t) for i, t in enumerate(made)]
    docs = spark.createDataFrame(rows, "part int, text string").repartition(5)
    got = fp.merged(fp.fingerprints(docs), ["part"]).collect()
    assert len(got) == 4
    for r in got:
        whole = np.unique(np.concatenate([shingle_set(t) for p, t in rows if p == r.part]))
        assert r.fingerprint == fp.pack(whole[: fp.K])


def test_small_tables(spark):
    docs = spark.createDataFrame([(5, "one two three four five six seven eight")], "doc_id long, text string")
    only = fp.neighbours(docs).collect()
    assert len(only) == 1 and only[0].near_next == 1
    assert fp.neighbours(docs.limit(0)).collect() == []
    odd = spark.createDataFrame([(None, None), (None, "a b"), (1, ""), (1, "")], "doc_id long, text string")
    got = fp.neighbours(odd).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in got) == [("1", 0), ("1", 0), ("None", 0), ("None", 3)]
