from itertools import product

import numpy as np
import pytest

from strata.llm import toxicity
from test_quality import auc

SF = "/root/testdata/sf0.01"


def brute(emissions, pairs):
    """Marginals by summing over all tag sequences."""
    n, total = len(emissions), 0.0
    toxic = np.zeros(n)
    for tags in product((0, 1), repeat=n):
        value = np.exp(sum(e for e, t in zip(emissions, tags) if t) + sum(pairs[a, b] for a, b in zip(tags, tags[1:])))
        total += value
        toxic += value * np.array(tags)
    return toxic / total


def test_marginals_equal_brute_force():
    rng = np.random.default_rng(1)
    lengths = np.array([3, 0, 1, 7, 5, 0])
    pairs = rng.normal(0, 1.5, (2, 2))
    emissions = rng.normal(-1, 2, lengths.sum())
    got = toxicity.marginals(emissions, lengths, pairs)
    own, expected = toxicity._pair_expectations(emissions, lengths, pairs)
    assert np.allclose(got, own)
    start = 0
    for n in lengths:
        if n:
            assert np.allclose(got[start : start + n], brute(emissions[start : start + n], pairs), atol=1e-6)
        start += n
    inner = sum(max(0, n - 1) for n in lengths)
    assert abs(expected.sum() - inner) < 1e-9


def test_the_field_finds_unlabelled_spans():
    rng = np.random.default_rng(4)
    plain, bad = [f"word{i}" for i in range(300)], [f"insult{i}" for i in range(12)]
    rows = []
    for i in range(400):
        words = list(rng.choice(plain, 40))
        if i % 4 == 0:
            for place in rng.integers(0, 40, 5):
                words[int(place)] = str(rng.choice(bad))
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    model = toxicity.train(rows[:300])
    tagger = toxicity.Tagger(model)
    texts = [t for _, t, _ in rows[300:]]
    scores = model.score(tagger.summaries(texts))
    assert auc([y for _, _, y in rows[300:]], scores) > 0.99
    right = wrong = 0
    for text, own in zip(texts, tagger.tag(texts)):
        for span in toxicity.spans(text, own):
            for word in text[span["start"] : span["end"]].split():
                right, wrong = right + word.startswith("insult"), wrong + (not word.startswith("insult"))
    assert right > 80 and wrong < 0.1 * right


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = toxicity.predictions(docs, labels).collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([truth[r.doc_id] == r.predicted for r in held]) > 0.9


@pytest.mark.parametrize("kinds", [[], [1], [0, 1]])
def test_odd_rows(spark, kinds):
    rows = [(None, "a b", "z"), (1, None, "z"), (2, "", "z"), (2, "", "z"), (3, "long " * 40_000, None), (7, "!! ??", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxicity string")
    labels = spark.createDataFrame([(7 + i, k, k) for i, k in enumerate(kinds)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.predictions(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.predictions(docs.limit(0), labels).count() == 0
