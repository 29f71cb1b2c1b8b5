"""Mixing sources to target weights by nested hash thresholds.

Every source is given a budget of words.  Whole passes over the source come
first; what is left of the budget takes the documents whose ticket, a hash of
the document, lies below a threshold.  The threshold is found from histograms:
words are summed by source and ticket bucket, the bucket in which the budget
runs out is found by running sums over the buckets, and only the rows of that
bucket are summed again by finer buckets, until one ticket is left.  Rows with
that ticket are equal in doc_id and text; as many of them are taken as come
nearest to the budget, counted off partition by partition.  No row is
sorted, and no group of rows meets in one task: sums are formed before the
shuffle, and one row per (source, bucket) is moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import WORD, text_of
from strata.session import broadcast_if_small, written

TICKET_BITS = 60
LEVEL_BITS = 12


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def ticket() -> Column:
    """60 bits that depend on doc_id and text; nulls are empty."""
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\x1f"), text_of())
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def targets(
    sizes: DataFrame, weights: tuple[float, ...], share: float, most: float
) -> DataFrame:
    """Add ``target`` to one row per source (``source``, ``source_size``).

    Sources in order of code points, null last, weigh ``weights`` repeated.  They
    share ``share`` times all words by weight; a target stops at ``most`` times
    its source, and the excess is shared again by weight.  That is a level: in
    order of ``source_size / weight``, sources are full until the level that the
    rest of the words gives to the rest of the weights is reached.
    The input is one row per source, so one window holds it.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    full = Window.orderBy("__ratio", "__place")
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    onward = full.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    ranked = (
        sizes.withColumn("__place", F.row_number().over(place) - 1)
        .withColumn("__weight", cycle[F.col("__place") % len(weights)])
        .withColumn("__ratio", F.col("source_size") / F.col("__weight"))
        .withColumn("__total", F.sum("source_size").over(whole))
        .withColumn("__full", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("__rest_weight", F.sum("__weight").over(onward))
        .withColumn(
            "__level", (F.lit(share) * F.col("__total") - F.lit(most) * F.col("__full")) / F.col("__rest_weight")
        )
        .withColumn("__is_full", F.lit(most) * F.col("source_size") <= F.col("__level") * F.col("__weight"))
    )
    level = F.min(F.when(~F.col("__is_full"), F.struct("__ratio", "__place", "__level"))).over(whole)["__level"]
    target = F.when(F.col("__is_full"), F.lit(most) * F.col("source_size")).otherwise(
        level * F.col("__weight")
    )
    return ranked.withColumn("target", target).select("source", "source_size", "target")


def _shift(column: str, bits: int) -> Column:
    return F.shiftright(F.col(column), bits)


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """The ticket at which each budget (``source``, ``rest``) runs out: source, limit, equal, extra.

    Tickets below ``limit`` fit the budget; of the ``equal`` rows with this ticket
    ``extra`` come nearest to it.  ``sized`` holds ``source``, ``size`` and ``ticket``.
    A source that its budget takes whole has no row.
    """
    state = budgets.select("source", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    rows = sized.where("size > 0").select("source", "size", "ticket")
    left = TICKET_BITS
    while left:
        step = min(LEVEL_BITS, left)
        if left < TICKET_BITS:
            at = broadcast_if_small(state.select(F.col("source").alias("__source"), "prefix"))
            rows = rows.join(
                at, F.col("source").eqNullSafe(F.col("__source")) & (_shift("ticket", left) == F.col("prefix"))
            ).select("source", "size", "ticket")
            rows = written(rows, "mix-boundary")
        left -= step
        cells = rows.groupBy("source", _shift("ticket", left).alias("cell")).agg(F.sum("size").alias("words"))
        upto = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
        sums = cells.withColumn("__upto", F.sum("words").over(upto)).withColumnRenamed("source", "__source")
        found = (
            sums.join(
                broadcast_if_small(state.select("source", "rest", "below")),
                F.col("source").eqNullSafe(F.col("__source")),
            )
            .where(F.col("below") + F.col("__upto") > F.col("rest"))
            .groupBy("source", "rest", "below")
            .agg(F.min(F.struct("cell", "words", "__upto")).alias("first"))
        )
        state = found.select(
            "source",
            "rest",
            F.col("first.cell").alias("prefix"),
            (F.col("below") + F.col("first.__upto") - F.col("first.words")).alias("below"),
            F.col("first.words").alias("at"),
        )
        state = written(state, "mix-thresholds")
    last = state.select(F.col("source").alias("__source"), "prefix")
    same = rows.join(
        broadcast_if_small(last), F.col("source").eqNullSafe(F.col("__source")) & (F.col("ticket") == F.col("prefix"))
    )
    counts = same.groupBy(F.col("__source")).agg(F.count(F.lit(1)).alias("equal"))
    joined = state.join(broadcast_if_small(counts), F.col("source").eqNullSafe(F.col("__source")))
    unit = F.col("at") / F.col("equal")
    extra = F.floor((F.col("rest") - F.col("below")) / unit + 0.5).cast("long")
    return joined.select("source", F.col("prefix").alias("limit"), "equal", F.least(extra, F.col("equal")).alias("extra"))


def _plan(sized: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """One row per source: __source, source_size, target, passes, limit, equal, extra."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(totals, weights, share, most)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = plan.withColumn("passes", passes.cast("long"))
    plan = written(plan.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")), "mix-targets")
    limits = thresholds(sized, plan.where("rest > 0").select("source", "rest"))
    found = plan.join(
        limits.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source")), "left"
    ).select(
        F.col("source").alias("__source"),
        "source_size",
        "target",
        "passes",
        F.coalesce("limit", F.lit(0)).alias("limit"),
        F.coalesce("equal", F.lit(0)).alias("equal"),
        F.coalesce("extra", F.lit(0)).alias("extra"),
    )
    return written(found, "mix-plan")


def _counted(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Add source_size, target and ``times`` to ``rows`` (source, ticket, and any others), row by row.

    Only the rows at a source's limit are looked at together, if some of them are
    taken and others not: they are counted off by the partition they are in.
    """
    joined = rows.join(broadcast_if_small(plan), F.col("source").eqNullSafe(F.col("__source")))
    partly = (F.col("ticket") == F.col("limit")) & (F.col("extra") > 0) & (F.col("extra") < F.col("equal"))
    more = (F.col("ticket") < F.col("limit")) | ((F.col("ticket") == F.col("limit")) & (F.col("extra") > 0))
    names = [*rows.columns, "source_size", "target"]
    sure = joined.where(~partly).select(*names, (F.col("passes") + more.cast("long")).alias("times"))
    # Stored, so that the number of a row's partition is decided once.
    shared = written(joined.where(partly).withColumn("__part", F.spark_partition_id()), "mix-shared")
    sizes = shared.groupBy("__source", "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__source").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col("__source").alias("__of"), F.col("__part").alias("__at"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")
    )
    inside = Window.partitionBy("__source", "__part").orderBy("__order")
    numbered = shared.withColumn("__order", F.xxhash64(*rows.columns)).withColumn("__number", F.row_number().over(inside))
    placed = numbered.join(offsets, F.col("__source").eqNullSafe(F.col("__of")) & (F.col("__part") == F.col("__at")))
    taken = F.col("__before") + F.col("__number") <= F.col("extra")
    return sure.unionAll(placed.select(*names, (F.col("passes") + taken.cast("long")).alias("times")))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
) -> DataFrame:
    """How many words of every document the mixture takes.

    ``docs`` needs doc_id, text and source; other columns are ignored.  Returns
    one row per row of ``docs``: doc_id, source, size, source_size, target,
    taken, times (how often the document is in the mixture).  A null text has no
    words; a null source is a source of its own, ordered last; an empty table
    gives no rows.  Rows that are equal in doc_id and text are taken in part where
    the budget runs out among them, so a source of nothing but equal rows, of one
    doc_id or of null ones comes near its target too.  Reruns agree, because
    tickets depend on the rows only.
    """
    sized = written(
        docs.select("doc_id", "source", word_count(text_of()).alias("size"), ticket().alias("ticket")), "mix-sizes"
    )
    rows = _counted(sized, _plan(sized, weights, share, most))
    return rows.select(
        "doc_id", "source", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"), "times"
    )


def repeated(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """The rows of the mixture: every row of ``docs`` as often as it is taken, with all its columns.

    How often follows from a row's ticket and the plan of its source, as in
    :func:`mix`; texts are not moved.  Null doc_ids, texts and sources, rows that
    repeat and empty tables are treated as there.
    """
    sized = written(docs.select("source", word_count(text_of()).alias("size"), ticket().alias("ticket")), "mix-sizes")
    plan = _plan(sized, weights, share, most)
    # One column for the row, so that no name of it can clash.
    rows = docs.select(F.struct(*docs.columns).alias("row"), "source", ticket().alias("ticket"))
    often = _counted(rows, plan).where("times > 0")
    each = often.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return each.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def mix_sql(table: str = "documents") -> str:
    """The rows of the query in DuckDB SQL, by sorting tickets instead of summing buckets."""
    return f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || chr(31) || coalesce(text, '')), 1, 15))::BIGINT AS ticket
  FROM {table}),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM totals),
weighed AS (SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM placed),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER (
        ORDER BY source_size::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
marked AS (SELECT *, 2.0::DOUBLE * source_size <= level * weight AS is_full FROM levels),
cut AS (SELECT level FROM marked WHERE NOT is_full ORDER BY source_size::DOUBLE / weight, place LIMIT 1),
goals AS (SELECT source, source_size, CASE WHEN is_full THEN 2.0::DOUBLE * source_size
      ELSE (SELECT level FROM cut) * weight END AS target FROM marked),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS passes FROM goals),
budget AS (SELECT *, target - passes * source_size AS rest FROM plan),
tickets AS (
  SELECT source, ticket, sum(size) AS words, count(*) AS equal FROM sized WHERE size > 0 GROUP BY source, ticket),
sums AS (
  SELECT *, sum(words) OVER (PARTITION BY source ORDER BY ticket) AS upto FROM tickets),
crossing AS (
  SELECT b.source, min_by(ticket, ticket) AS last, min_by(words, ticket) AS words, min_by(equal, ticket) AS equal,
    min_by(upto, ticket) AS upto, any_value(b.rest) AS rest
  FROM sums s JOIN budget b ON s.source IS NOT DISTINCT FROM b.source
  WHERE b.rest > 0 AND upto > b.rest GROUP BY b.source),
limits AS (
  SELECT source, last, least(equal, floor((rest - (upto - words)) / (words / equal) + 0.5)) AS extra FROM crossing),
numbered AS (SELECT *, row_number() OVER (PARTITION BY source, ticket) AS number FROM sized)
SELECT d.doc_id, d.size, b.source_size, b.target,
       (d.size * (b.passes + CASE WHEN d.ticket < l.last OR (d.ticket = l.last AND d.number <= l.extra) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM numbered d JOIN budget b ON d.source IS NOT DISTINCT FROM b.source
LEFT JOIN limits l ON d.source IS NOT DISTINCT FROM l.source"""
