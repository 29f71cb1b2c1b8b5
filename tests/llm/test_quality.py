import zlib

import numpy as np
import pytest

from strata.llm import labelled, quality

SF = "/root/testdata/sf0.01"


def auc(labels, scores):
    pairs = [(a > b) + (a == b) / 2 for a, y in zip(scores, labels) if y for b, z in zip(scores, labels) if not z]
    return float(np.mean(pairs))


def test_features_stay_with_their_word():
    words = ["a", "word", "Wörd!!", "\U0001f525", "x" * 300]
    buckets, counts = quality.features(words)
    assert counts.sum() == len(buckets) and (buckets > 0).all()
    start = 0
    for word, n in zip(words, counts):
        alone, _ = quality.features([word])
        assert sorted(alone) == sorted(buckets[start : start + n])
        start += n


def test_scores_do_not_depend_on_batches(monkeypatch):
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["aa", "bb", "cc!", "dd"], int(rng.integers(0, 30)))) for _ in range(50)]
    model = quality.train([(i, t, i % 2) for i, t in enumerate(texts)])
    whole = quality.Scorer(model).scores(texts)
    monkeypatch.setattr(quality, "BATCH_WORDS", 7)
    monkeypatch.setattr(quality, "CACHED_WORDS", 2)
    assert np.allclose(whole, quality.Scorer(model).scores(texts), atol=1e-6)
    for text, score in zip(texts, whole):
        buckets, shares = quality._document(text)
        mean = shares @ model.vectors[buckets] if len(buckets) else np.zeros(quality.DIMENSIONS)
        assert abs(model.score(mean[None])[0] - score) < 1e-5


def test_held_out_accuracy_and_folds(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = quality.predictions(docs, labels).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert auc([truth[r.doc_id] for r in held], [r.score for r in held]) > 0.97
    sampled = labelled.sample(docs, labels, "quality")
    assert all(zlib.crc32(str(i).encode()) % 5 for i, _, _ in sampled)
    assert len(labelled.sample(docs, labels, "quality", rows=10)) == 10


@pytest.mark.parametrize("kinds", [[], [1], [0, 1]])
def test_odd_rows(spark, kinds):
    rows = [(None, "a b", "z"), (1, None, "z"), (2, "", "z"), (2, "", "z"), (3, "long " * 40_000, None), (7, "ok text", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(7 + i, k, k) for i, k in enumerate(kinds)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = quality.predictions(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert quality.predictions(docs.limit(0), labels).count() == 0
    kept = quality.keep_good(docs, labels, least=0.0)
    assert kept.columns == docs.columns and kept.count() == len(rows)
