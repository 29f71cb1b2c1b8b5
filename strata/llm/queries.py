"""The operators applied to the given tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strata.llm import (
    align_tokens,
    bpe,
    exact_dedup,
    fill_middle,
    fingerprints,
    html_extract,
    minhash,
    mixing,
    pii,
    quality,
    sharding,
    toxicity,
    url_filter,
)

Run = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Run] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def add(run: Run) -> Run:
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_minhash", minhash.near_sql())
def op1_minhash(spark, sf_dir):
    """Components of texts that share three quarters of their word shingles."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


@query("op2_fingerprints")
def op2_fingerprints(spark, sf_dir):
    """Sketches of every text and its edited text, and its likeness to them and the next one."""
    return fingerprints.neighbours(_table(spark, sf_dir, "documents"))


@query("op3_toxicity")
def op3_toxicity(spark, sf_dir):
    """Toxicity of every text, with the offending places."""
    return toxicity.predictions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query("op4_mixing", mixing.mix_sql())
def op4_mixing(spark, sf_dir):
    """Words that a mixture at 150 % of all words takes from every document."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op5_html")
def op5_html(spark, sf_dir):
    """Main text of every page."""
    return html_extract.extract(_table(spark, sf_dir, "pages"))


@query("op6_sharding", sharding.shards_sql())
def op6_sharding(spark, sf_dir):
    """24 contiguous shards of near equal bytes."""
    return sharding.shards(_table(spark, sf_dir, "documents"))


def vocabulary() -> tuple[str, str]:
    """Rank file and pattern of the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@query("op7_bpe")
def op7_bpe(spark, sf_dir):
    """Byte-level BPE ids of every text and their decoding, as digests."""
    return bpe.round_trips(_table(spark, sf_dir, "documents"), *vocabulary())


@query("op8_pii", pii.report_sql())
def op8_pii(spark, sf_dir):
    """Personal data in every text, with the scores that the context words adjust."""
    return pii.report(_table(spark, sf_dir, "documents"))


@query("op9_quality")
def op9_quality(spark, sf_dir):
    """Quality of every text."""
    return quality.predictions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query("op10_exact_dedup", exact_dedup.exact_sql())
def op10_exact_dedup(spark, sf_dir):
    """Groups of texts that are equal without white space."""
    groups = exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


# Rules of the data contract (fixed values).
URL_RULES = ["allow com/", "block example.com/en/", "allow www.example.com/en/", "block net/es/", "block net/fr/"]


@query("op11_url_filter")
def op11_url_filter(spark, sf_dir):
    """Verdict on every page's URL, by rules and by trees that learn from what the rules decide."""
    return url_filter.judge(_table(spark, sf_dir, "pages"), url_filter.rules(URL_RULES))


@query("op12_align_tokens")
def op12_align_tokens(spark, sf_dir):
    """Groups and links of two tokenizers over every text, with corpus-wide counts of linked ids."""
    import public_tokenizers

    paths = map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return align_tokens.report(_table(spark, sf_dir, "documents"), align_tokens.tokenizers(*paths, public_tokenizers.PATTERN))


@query("op13_fill_middle", fill_middle.report_sql())
def op13_fill_middle(spark, sf_dir):
    """Every text with its middle moved to the end, and restored from that, as digests."""
    return fill_middle.report(_table(spark, sf_dir, "documents"))
