"""The pipeline against a plain version of each stage, and the entry without it."""

import os
import shutil
import subprocess
import sys
from collections import Counter

import public_tokenizers as public
import tiktoken

import corpus_pipeline
from strata.llm import bpe, quality
from test_exact_dedup import brute as brute_exact
from test_minhash import brute as brute_near
from test_mixing import brute_targets, size

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))


def rows_of(df):
    return sorted((r.doc_id, r.text, r.source) for r in df.collect())


def test_every_stage_equals_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(stages) == 5
    seen = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "byte-level bpe":
            assert out.columns == docs.columns, name
        seen[name] = docs = spark.createDataFrame(out.collect(), out.schema)

    first = rows_of(seen["documents"])
    model = quality.fit(seen["documents"], spark.read.parquet(f"{SF}/labels.parquet"))
    scores = quality.Scorer(model).scores(t for _, t, _ in first)
    good = [r for r, s in zip(first, scores) if s >= quality.KEEP_SCORE]
    assert rows_of(seen["quality classifier"]) == good and len(good) < len(first)

    stay = {r[0] for r in brute_exact(good) if r[3]}
    once = [r for r in good if str(r[0]) in stay]
    assert rows_of(seen["exact dedup"]) == once and len(once) < len(good)

    near = {i for i, _, c in brute_near([(i, t) for i, t, _ in once]) if i == c}
    apart = [r for r in once if str(r[0]) in near]
    assert rows_of(seen["minhash near-dedup"]) == apart

    sizes = Counter()
    for _, text, source in apart:
        sizes[source] += size(text)
    want, got = brute_targets(dict(sizes)), Counter()
    mixed = rows_of(seen["mixing sources to target weights"])
    assert set(mixed) <= set(apart) and max(Counter(mixed).values()) <= 2
    for _, text, source in mixed:
        got[source] += size(text)
    largest = max(size(t) for _, t, _ in apart)
    assert all(abs(got[s] - want[s]) <= largest for s in want)

    reference = tiktoken.Encoding(
        "own", pat_str=public.PATTERN, mergeable_ranks=bpe.read_ranks(public.path("byte_bpe_multi_50k.tiktoken")), special_tokens={}
    )
    coded = sorted((r.doc_id, tuple(r.token_ids), r.n_tokens, r.round_trip) for r in seen["byte-level bpe"].collect())
    ids = [(i, tuple(reference.encode_ordinary(t))) for i, t, _ in mixed]
    assert coded == sorted((i, x, len(x), True) for i, x in ids)


def test_run_writes_the_last_stage(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "source", "n_tokens", "token_ids", "round_trip"] and got.count() > 0


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_the_entry_works_without_this_folder(tmp_path):
    for name in ("strata", "__spark_entry__.py"):
        source = os.path.join(ROOT, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; n = e.queries(); assert len(n) > 100 and not [x for x in n if re.match('op[0-9]', x)]"
    done = subprocess.run([sys.executable, "-c", "import re; " + code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
