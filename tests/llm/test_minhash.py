import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from strata.llm import minhash, shingles
from strata.llm.components import components


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for white in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(white, " ")
    return [w for w in lowered.split(" ") if w]


def brute_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """(doc_id, size, component) by comparing all pairs."""
    sets = [(i, brute_set(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is None or j is None or not a or not b:
                continue
            both = len(a & b)
            if 100 * both >= 75 * (len(a) + len(b) - both):
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    return sorted((str(i), len(s), str(None if i is None else root(i))) for i, s in sets)


def result(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


@given(st.text(alphabet="aB \t\n\x0b\x1c\x85é,", max_size=60))
@settings(max_examples=200, deadline=None)
def test_shingles_equal_brute_force(text):
    assert len(shingles.shingle_set(text)) == len(brute_set(text))


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    for share in (0.9, 0.75, 0.5, 0.2):
        got = []
        for _ in range(30):
            pool = rng.integers(0, 2**63, 2000).astype(np.uint64)
            common = int(1000 * share)
            a, b = pool[:1000], np.concatenate([pool[:common], pool[1000 : 2000 - common]])
            got.append(np.mean(minhash.signature(np.unique(a), 384) == minhash.signature(np.unique(b), 384)))
        true = common / (2000 - common)
        assert abs(np.mean(got) - true) < 0.03


def test_components_of_chains_stars_and_nothing(spark):
    chain = [(i, i + 1) for i in range(1, 40)]
    star = [(100, i) for i in range(101, 130)] + [(130, 129), (131, 130), (5, 5)]
    got = {r.vertex: r.root for r in components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(2, 41)} | {i: 100 for i in range(101, 132)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def made_rows():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(3000)]

    def text(n):
        return list(rng.choice(vocabulary, n))

    rows, passage = [], text(60)
    for g in range(12):
        base = text(int(rng.integers(30, 200)))
        for _ in range(int(rng.integers(1, 9))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 5))):
                copy[int(rng.integers(len(copy)))] = "edited"
            rows.append(" ".join(copy))
    chain = text(120)  # each link of the chain differs a little from the one before
    for k in range(12):
        rows.append(" ".join(chain))
        chain = chain[4:] + text(4)
    rows += [" ".join(text(15) + passage + text(15)) for _ in range(15)]
    rows += ["one two", "ONE two", "one two three", "", None, " \n", "", "a b c d e", "A\tb c d e"]
    order = rng.permutation(len(rows))
    return [(int(i), rows[i2]) for i, i2 in enumerate(order)]


def test_equals_brute_force(spark):
    rows = made_rows()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    got = minhash.near_duplicates(docs)
    assert result(got) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.collect())
    kept = minhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(int(c) for c in {c for _, _, c in brute(rows)})


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(150):
        copy = list(base)
        for place in rng.integers(0, 150, int(rng.integers(0, 14))):
            copy[int(place)] = f"x{rng.integers(1000)}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows)
    assert len({c for _, _, c in want}) > 5
    assert result(minhash.near_duplicates(docs)) == want
    monkeypatch.setattr(minhash, "DIRECT_MEMBERS", 3)
    monkeypatch.setattr(minhash._linked_in_blocks, "__defaults__", (16,))
    assert result(minhash.near_duplicates(docs)) == want


def test_odd_rows(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (3, "x"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(docs)
    assert result(got) == sorted([("None", 2, "None")] * 2 + [("4", 2, "4")] * 2 + [("3", 1, "3"), ("9", 0, "9")])
    assert sorted(str(r.doc_id) for r in minhash.drop_near_copies(docs).collect()) == ["3", "4", "9", "None", "None"]
    assert minhash.near_duplicates(docs.limit(0)).collect() == []


def test_long_text(spark):
    long = " ".join(f"v{i}" for i in range(60_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, "short " * 50_000)], "doc_id long, text string")
    assert result(minhash.near_duplicates(docs)) == sorted([("1", 59996, "1"), ("2", 59997, "1"), ("3", 1, "3")])
