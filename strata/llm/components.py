"""Connected components of links between numbered vertices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.session import written


def _compressed(parents: DataFrame) -> DataFrame:
    """Point every vertex at its root: parents of parents, until nothing moves."""
    while True:
        up = parents.select(F.col("vertex").alias("__v"), F.col("parent").alias("__up"))
        stepped = parents.join(up, parents["parent"] == up["__v"], "left").select(
            "vertex", F.coalesce("__up", "parent").alias("parent"), F.col("__up").isNotNull().alias("moved")
        )
        stepped = written(stepped, "components-parents")
        moved = stepped.where("moved").limit(1).count()
        parents = stepped.select("vertex", "parent")
        if not moved:
            return parents


def _renamed(links: DataFrame, roots: DataFrame) -> DataFrame:
    """Links between roots, each once, without those inside one component."""
    for side in ("a", "b"):
        named = roots.select(F.col("vertex").alias("__v"), F.col("parent").alias("__root"))
        links = links.join(named, links[side] == named["__v"], "left").withColumn(
            side, F.coalesce("__root", side)
        ).select("a", "b")
    return _ordered(links)


def _ordered(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def extended(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` of :func:`components` after more links; only the links between components are followed."""
    known = roots.select("vertex", F.col("root").alias("parent"))
    found = components(_renamed(links, known)).withColumnRenamed("root", "parent")
    up = found.select(F.col("vertex").alias("__v"), F.col("parent").alias("__up"))
    moved = known.join(up, known["parent"] == up["__v"], "left").select(
        "vertex", F.coalesce("__up", "parent").alias("root")
    )
    return written(moved.unionByName(found.withColumnRenamed("parent", "root")), "components-roots")


def components(links: DataFrame) -> DataFrame:
    """``vertex`` and ``root``, the smallest vertex of its component, for vertices that are not roots.

    ``links`` has ``a`` and ``b``.  Every vertex hooks onto its smallest smaller
    neighbour, the trees are compressed by pointer jumping, and the links
    between trees go on to the next round.  Only one row per vertex or link is
    moved, minima are formed before the shuffle, and every round is written to
    the shared folder.
    """
    left = written(_ordered(links), "components-links")
    roots = None
    while left.limit(1).count():
        hooked = left.groupBy(F.col("b").alias("vertex")).agg(F.min("a").alias("parent"))
        found = _compressed(written(hooked, "components-hooks"))
        if roots is None:
            roots = found
        else:
            up = found.select(F.col("vertex").alias("__v"), F.col("parent").alias("__up"))
            moved = roots.join(up, roots["parent"] == up["__v"], "left").select(
                "vertex", F.coalesce("__up", "parent").alias("parent")
            )
            roots = written(moved.unionByName(found), "components-roots")
        left = written(_renamed(left, found), "components-links")
    if roots is None:
        roots = left.select(F.col("b").alias("vertex"), F.col("a").alias("parent"))
    return roots.select("vertex", F.col("parent").alias("root"))
