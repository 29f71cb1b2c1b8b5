"""Exact best-k search that scores a part of the postings only.

Posting rows of a segmented index carry an upper bound of their scores for every
block of documents.  The blocks that promise most are scored first and give each
query a lower bound for its k-th score.  Then the query's terms are taken in
tiers, those with the largest bounds first.  The first tier holds every term
without which a document cannot reach the lower bound; after each tier documents
are dropped that cannot reach it with all that their block still promises.  Later
tiers look at postings of the remaining documents only, so frequent terms with
small weights, which have most postings, are scored for few documents.

All this happens bucket by bucket, in one task each (``bounded``); only the best k
rows of a query and bucket leave it.  A bucket's lower bounds are its own.

The result is the same as that of a search over all matches.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from strata.functions import text as X
from strata.operators import bounded, scoring
from strata.operators.ranking import top_k
from strata.operators.retrieval import K1, B, idf, query_terms
from strata.operators.segments import Store
from strata.session import MAX_BROADCAST_ROWS, written

SCHEMA = "__bucket int, date string, block int, number int, peak_tfs array<int>, peak_dls array<int>, ats array<int>, tfs array<int>, docid string, dl int, at int"


def _bucketed(store: Store, posed: DataFrame, on: list[str], dates: list[str] | None) -> DataFrame:
    """Living documents, and posting rows of the ``posed`` terms (on, number): a partition for each bucket."""
    parts = [p for p in store.parts if dates is None or p[1] in dates]
    first = [0, *accumulate(n for _, _, n in parts)]
    # One row for each segment and slice.
    places = store.spark.createDataFrame([(s, d, f) for (s, d, _), f in zip(parts, first)], "segment string, date string, __first int")
    of = (F.col("__first") + F.col("bucket")).alias("__bucket")
    rows = store.table("postings", dates).join(F.broadcast(posed), on).join(F.broadcast(places), ["segment", "date"])
    rows = rows.select(of, "date", "block", "number", F.col("peaks.tf").alias("peak_tfs"), F.col("peaks.dl").alias("peak_dls"), "ats", "tfs")
    docs = store.documents(dates).join(F.broadcast(places), ["segment", "date"]).select(of, "date", "block", "at", "docid", "dl")
    both = rows.unionByName(docs, allowMissingColumns=True).select(*StructType.fromDDL(SCHEMA).names)
    return both.repartitionById(max(1, first[-1]), "__bucket")


def _found(store: Store, terms: DataFrame, own: list[str], rules: bounded.Rules, dates, sums: list) -> DataFrame | None:
    """The best rows of every query and bucket; ``terms`` of queries fit the driver.  ``sums``, if not None, receives the rows that count postings."""
    spark = store.spark
    on = ["date", "term"] if "date" in own else ["term"]
    rows = terms.select(*own, "term", "qtf").toArrow().to_pylist()
    wanted = terms.select(*on).distinct()
    stats = store.term_stats(dates, wanted).join(F.broadcast(store.slice_stats(dates)), "date")  # one row per slice
    weights = stats.select("date", "term", "avgdl", idf(F.col("n_docs"), F.col("df")).alias("idf")).toArrow()
    if not rows or not len(weights):
        return None
    # Queries are numbered within their slice, or within all.
    numbers: dict = {}
    asked: dict = {}
    for row in rows:
        of = row["date"] if "date" in own else None
        seen = numbers.setdefault(of, {})
        number = seen.setdefault(tuple(row[c] for c in own), len(seen))
        asked.setdefault(of, []).append((number, row["term"], row["qtf"]))
    posed = {of: scoring.posed_queries(*zip(*told)) for of, told in asked.items()}
    places = {of: {t: i for i, t in enumerate(p.terms.to_pylist())} for of, p in posed.items()}
    slices: dict = {}
    for date, term, avgdl, weight in zip(*[weights[c].to_pylist() for c in weights.column_names]):
        of = date if "date" in own else None
        if date not in slices:
            slices[date] = scoring.Slice(posed[of], np.zeros(len(places[of])), avgdl)
        slices[date].idf[places[of][term]] = weight

    numbered = [(*([of] if "date" in own else []), t, i) for of, seen in places.items() for t, i in seen.items()]
    numbered = spark.createDataFrame(numbered, ", ".join([*[f"{c} string" for c in on], "number int"]))
    schema = StructType.fromDDL("date string, __query int, docid string, score double, all bigint, scored bigint")
    best = _bucketed(store, numbered, on, dates).mapInArrow(bounded.best_of_bucket(slices, rules, to_arrow_schema(schema)), schema)
    if sums is not None:
        best = written(best, "pruned")
        sums.append(best.agg(F.sum("all").alias("all"), F.sum("scored").alias("scored")).first())
    # One row for each query.
    told = [(*row, i) for seen in numbers.values() for row, i in seen.items()]
    named = spark.createDataFrame(told, StructType([*terms.select(*own).schema.fields, schema["__query"]]))
    found = best.where(F.col("__query") >= 0)
    return found.join(F.broadcast(named), [c for c in ("date", "__query") if c in named.columns])


def search(
    store: Store,
    queries: DataFrame,
    keys: list[str],
    k: int = 100,
    analyzer: X.Analyzer = X.light_tokens,
    k1: float = K1,
    b: float = B,
    tiers: int = 4,
    dates: list[str] | None = None,
    digits: int = 6,
    max_broadcast: int = MAX_BROADCAST_ROWS,
    cost: dict[str, int] | None = None,
) -> DataFrame:
    """Best ``k`` documents per query: ``keys, rank (from 0), docid, score``.

    ``keys`` identify a query and contain ``date``; queries without a ``date``
    column are posed to every slice, those with a null in their keys to none.
    Queries with more than ``max_broadcast`` terms and slices are searched in
    groups.  ``cost``, if given, receives the postings of all query terms
    (``all``) and those that were scored (``scored``).
    """
    own = [c for c in keys if c != "date" or "date" in queries.columns]
    terms = query_terms(queries.dropna(subset=own), own, analyzer)
    slices = 1 if "date" in own else max(1, len({d for _, d, _ in store.parts if dates is None or d in dates}))
    n_terms = terms.count()
    groups = 1
    if n_terms * slices > max_broadcast:
        terms = written(terms, "query-terms")
        groups = min(-(-n_terms * slices // max(1, max_broadcast)), terms.select(*own).distinct().count())
    rules = bounded.Rules(k, k1, b, tiers, digits)
    sums: list | None = None if cost is None else []
    of = F.pmod(F.xxhash64(*own), F.lit(groups))
    found = [_found(store, terms if groups == 1 else terms.where(of == i), own, rules, dates, sums) for i in range(groups)]
    found = [f.select(*keys, "docid", "score") for f in found if f is not None]
    if cost is not None:
        for c in ("all", "scored"):
            cost[c] = sum(s[c] or 0 for s in sums)
    if not found:
        empty = StructType([*[queries.schema[c] if c in own else StructType.fromDDL(SCHEMA)[c] for c in keys], *StructType.fromDDL("rank int, docid string, score double")])
        return store.spark.createDataFrame([], empty)
    ranked = top_k(reduce(DataFrame.unionByName, found), keys, [F.desc("score"), F.asc("docid")], k)
    return ranked.select(*keys, "rank", "docid", "score")
