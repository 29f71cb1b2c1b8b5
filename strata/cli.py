"""Command line: ``python -m strata <command> --help``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from strata.functions import text as X
from strata.operators import clean, models
from strata.plans import jobs
from strata.sources import readers
from strata.sources.collections import ParquetCollection, TestCollection, TrainCollection, TrecCollection

ANALYZERS = {"french": X.french_tokens, "light": X.light_tokens, "simple": X.simple_tokens}


def numbers(kind):
    return lambda text: [kind(part) for part in text.split(",")]


def names(text: str) -> list[str]:
    return [part.strip() for part in text.split(",") if part.strip()]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strata", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *positional: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=text)
        for argument in positional:
            c.add_argument(argument, type=names if argument == "roots" else str)
        return c

    c = command("dev-sample", "first records of every JSON file", "input", "output")
    c.add_argument("--limit", type=int, default=10)
    c = command("parquet", "JSON release to partitioned parquet", "input", "output")
    c.add_argument("--split", choices=["train", "test"], default="train")
    c = command("trec-parquet", "markup slices to partitioned parquet", "input", "output")
    c.add_argument("--split", default="train")
    c.add_argument("--dates", type=names)
    c.add_argument("--qrels-root")
    command("tokens", "token and word statistics", "roots", "output")
    command("diagnostics", "lengths, uniqueness and English density, one pass", "roots", "output")
    c = command("embedding", "embeddings by hashed words, as a stand-in for a model", "roots", "output")
    c.add_argument("--shards", type=int, default=8)
    c.add_argument("--dims", type=int, default=64)
    c = command("lda-preprocess", "tokens, phrases, vocabulary, term vectors", "roots", "output")
    c.add_argument("--date", default=clean.POOLED)
    c.add_argument("--sample", type=float, default=1.0)
    c.add_argument("--min-count", type=int, default=20)
    c.add_argument("--threshold", type=float, default=0.5)
    c.add_argument("--vocabulary-size", type=int, default=20_000)
    c.add_argument("--min-df", type=float, default=50)
    c.add_argument("--max-df", type=float, default=0.2)
    c.add_argument("--analyzer", choices=ANALYZERS, default="french")
    c = command("lda-sweep", "fit, infer and score topic models", "prepared", "output")
    c.add_argument("--ks", type=numbers(int), default=[20])
    c.add_argument("--max-iter", type=int, default=10)
    c = command("lda-topic-proportions", "proportions per slice and drift", "trained", "output")
    c.add_argument("--ks", type=numbers(int), default=[20])
    c = command("lda-heldout-drift", "score new slices with trained models", "prepared", "trained", "roots", "output")
    c.add_argument("--ks", type=numbers(int), default=[20])
    c.add_argument("--analyzer", choices=ANALYZERS, default="french")
    c = command("lda-conv-probe", "held-out perplexity over training settings", "prepared", "output")
    c.add_argument("--k", type=int, default=20)
    c.add_argument("--iterations", type=numbers(int), default=[10, 50])
    c.add_argument("--offsets", type=numbers(float), default=[64.0, 1024.0])
    c = command("lda-query-topics", "topics of the queries with trained models", "prepared", "trained", "roots", "output")
    c.add_argument("--k", type=int, default=20)
    c.add_argument("--analyzer", choices=ANALYZERS, default="french")
    c = command("nmf", "TF-IDF and non-negative factors", "roots", "output")
    c.add_argument("--k", type=int, default=20)
    c.add_argument("--date", default=clean.POOLED)
    c.add_argument("--sample", type=float, default=1.0)
    c = command("bm25", "index, retrieve, evaluate", "roots", "output")
    c.add_argument("--k", type=int, default=100)
    c.add_argument("--shards", type=int, default=8)
    c.add_argument("--expansions")
    c.add_argument("--analyzer", choices=ANALYZERS, default="french")
    c = command("rerank", "score candidates by word overlap, as a stand-in for a model", "roots", "run", "output")
    c.add_argument("--seeds", type=numbers(int), default=[42])
    c.add_argument("--queries", type=int, default=0)
    c = command("evaluate", "score stored runs (experiment, date, qid, docid, score)", "run", "qrels", "output")
    return p


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    analyzer = ANALYZERS[getattr(a, "analyzer", "simple")]
    if a.command == "dev-sample":
        readers.dev_sample(spark, a.input, a.limit).write.mode("overwrite").json(a.output)
    elif a.command == "parquet":
        kind = TrainCollection if a.split == "train" else TestCollection
        kind(spark, a.input).to_parquet(a.output)
    elif a.command == "trec-parquet":
        TrecCollection(spark, a.input, a.dates, a.split).to_parquet(a.output, a.qrels_root)
    elif a.command == "tokens":
        jobs.token_statistics(spark, a.roots, a.output)
    elif a.command == "diagnostics":
        jobs.diagnostics(spark, a.roots, a.output)
    elif a.command == "embedding":
        jobs.embeddings(spark, a.roots, a.output, models.hashing_model(a.dims), a.shards)
    elif a.command == "lda-preprocess":
        jobs.preprocess(
            spark,
            a.roots,
            a.output,
            a.date,
            a.sample,
            analyzer,
            a.min_count,
            a.threshold,
            vocabulary_size=a.vocabulary_size,
            min_df=a.min_df,
            max_df=a.max_df,
        )
    elif a.command == "lda-sweep":
        jobs.lda_sweep(spark, a.prepared, a.output, a.ks, max_iter=a.max_iter)
    elif a.command == "lda-topic-proportions":
        jobs.topic_proportions(spark, [f"{a.trained}/k{k}" for k in a.ks], a.ks, a.output)
    elif a.command == "lda-heldout-drift":
        jobs.heldout_drift(spark, a.prepared, a.trained, a.roots, a.output, a.ks, analyzer)
    elif a.command == "lda-conv-probe":
        jobs.convergence(spark, a.prepared, a.output, a.k, a.iterations, a.offsets)
    elif a.command == "lda-query-topics":
        queries = clean.union_all([ParquetCollection(spark, r).queries for r in a.roots], True)
        jobs.query_topics(spark, a.prepared, a.trained, queries, a.k, a.output, analyzer)
    elif a.command == "nmf":
        jobs.nmf(spark, a.roots, a.output, a.k, a.date, a.sample)
    elif a.command == "bm25":
        jobs.bm25(spark, a.roots, a.output, a.k, a.shards, a.expansions, analyzer)
    elif a.command == "rerank":
        jobs.rerank(spark, a.roots, a.run, a.output, models.overlap_scorer(), tuple(a.seeds), a.queries)
    elif a.command == "evaluate":
        jobs.evaluation(spark, spark.read.parquet(a.run), spark.read.parquet(a.qrels), a.output)


def main(argv: list[str] | None = None) -> None:
    arguments = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"strata {arguments.command}").getOrCreate()
    run(spark, arguments)


