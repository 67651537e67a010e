"""Connected components of an edge table, without collecting links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubspark.llm.common import stored


def _fold(e: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v) with u > v: hang neighbours on the least node each node knows.

    The large star looks at all neighbours and moves the greater ones; the small star looks at the
    lesser neighbours and moves those and the node itself.
    """
    sides = e.select("u", "v")
    if large:
        sides = sides.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = sides.join(least, "u")
    if large:
        moved = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
            least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node reachable.

    Alternating large and small stars: each round is two grouped minima joined back (an adaptive join
    splits a hot node), written to the shared folder, until nothing changes.  An empty table gives none.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
               "edges")
    was = None
    while True:
        seen = e.agg(F.count("*").alias("n"),
                     F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if tuple(seen) == was or not seen["n"]:
            break
        was = tuple(seen)
        e = stored(_fold(_fold(e, True), False), "stars")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
