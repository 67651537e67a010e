"""Mixing sources to target weights by hash-threshold histograms, in DataFrame functions only.

A document has a 64-bit hash.  Tokens are summed by source and 8-bit hash bucket; the bucket in which
a source's budget runs out is the only one refined by the next 8 bits, down to the single hash that
is the source's threshold.  No source ever has more than 256 sums in a window, whatever its share of
the rows, and after the first level only the boundary bucket's hashes are read again.  Documents below it are taken: a filter, no sort of documents.  Thresholds
of growing budgets are nested, so a larger mix contains a smaller one.  A target above its source's
size takes every document once and the threshold decides the second copies.

Rows that share source and whole hash (exact repeats) at a threshold are numbered in their scan
partitions, and the wanted number of them is taken.

Defined cases: NULL text has size 0; a NULL source is a source and comes last; an empty table gives an
empty result; sizes that are all 0 give targets of 0; other columns are kept or ignored, never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from scrubspark.llm.common import fresh, quoted, stored

#: Weights by rank of the source, repeating; share of all words to take; copies of a document at most.
WEIGHTS, SHARE, COPIES = (5, 2, 1), 1.5, 2
BITS, LEVELS = 8, 8


def word_count(text):
    flat = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.array_remove(F.split(flat, " "), "")).cast("long")


def ranked(df: DataFrame, column: str) -> DataFrame:
    """``df`` (distinct values of ``column``) with ``rank`` from 0 by code point, NULL last.

    Range partitions are numbered on their own and moved by the rows before them.
    """
    part = df.repartitionByRange(F.col(column).isNull(), F.col(column)).sortWithinPartitions(
        F.col(column).isNull(), F.col(column)).withColumn("at", F.monotonically_increasing_id())
    part = stored(part.withColumn("part", F.shiftright("at", 33)), "ranked")
    # One row per partition: as many as the session has shuffle partitions.
    before = part.groupBy("part").count().withColumn(
        "before", F.sum("count").over(W.Window.orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)))
    return part.join(before.drop("count"), "part").withColumn(
        "rank", F.coalesce("before", F.lit(0)) + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at", "part", "before")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    target = min(2 x size, level x weight): the level rises as full sources hand on their excess.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = ranked(per, "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    per = stored(per.select("source", "source_size", w.alias("w"),
                            (F.lit(COPIES) * F.col("source_size")).cast("double").alias("cap")), "sources")
    whole = share * (per.agg(F.sum("source_size")).first()[0] or 0)
    level, held = 0.0, -1
    while True:
        full = F.col("cap") <= F.col("w") * level
        row = per.agg(F.count_if(full).alias("n"), F.sum(F.when(full, F.col("cap"))).alias("cap"),
                      F.sum(F.when(~full, F.col("w"))).alias("w")).first()
        if row["n"] == held or not row["w"]:
            break
        held, level = row["n"], (whole - (row["cap"] or 0.0)) / row["w"]
    return per.select("source", "source_size", F.least("cap", F.col("w") * level).alias("target"))


def _bits(level: int):
    """Bits ``level`` x BITS of the hash, in signed order at the first level."""
    if level == 0:
        return F.shiftright("h", 64 - BITS)
    return F.shiftrightunsigned(F.shiftleft("h", level * BITS), 64 - BITS)


def thresholds(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """``goal`` with ``whole`` (copies every document gets), ``cut`` (the hash at which the budget runs out,
    NULL if it never does), ``wanted`` (rows to take at that hash) and ``there`` (rows with that hash)."""
    state = goal.withColumn("whole", (F.col("target") > F.col("source_size")).cast("long")).withColumn(
        "budget", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("cut", F.lit(0).cast("long"))
    state = stored(state, "budgets")
    inside = rows.select("source", "h", F.col("size").alias("s"), F.lit(1).cast("long").alias("n"))
    for level in range(LEVELS):
        sums = inside.withColumn("b", _bits(level)).groupBy("source", "b").agg(
            F.sum("s").alias("s"), F.sum("n").alias("n"))
        # At most 2^BITS buckets for a source.
        w = W.Window.partitionBy("source").orderBy("b")
        sums = sums.withColumn("cum", F.sum("s").over(w)).withColumnRenamed("source", "src")
        edge = sums.join(state.select(F.col("source").alias("src2"), F.col("budget").alias("room")),
                         F.col("src").eqNullSafe(F.col("src2"))).where("cum > room")
        edge = edge.groupBy("src").agg(F.min(F.struct("b", (F.col("cum") - F.col("s")).alias("used"), "s", "n")).alias("e"))
        state = state.drop("s", "there").join(edge, F.col("source").eqNullSafe(F.col("src")), "left")
        if level:
            state = state.where(F.col("e").isNotNull())
        step = F.shiftleft(F.col("e.b").cast("long"), 64 - (level + 1) * BITS)
        state = state.select("source", (F.col("budget") - F.col("e.used")).alias("budget"),
                             F.col("cut").bitwiseOR(step).alias("cut"), F.col("e.s").alias("s"), F.col("e.n").alias("there"))
        state = stored(state.where("cut is not null"), "boundary")
        if level + 1 < LEVELS:
            lead = (level + 1) * BITS
            inside = inside.join(
                state.select(F.col("source").alias("src"), F.col("cut").alias("c")),
                F.col("source").eqNullSafe(F.col("src"))
                & (F.shiftright("h", 64 - lead) == F.shiftright("c", 64 - lead))).select("source", "h", "s", "n")
            if level == 0:
                # Repeats of a hash become one row here, so a hot one is not carried from level to level.
                inside = stored(inside.groupBy("source", "h").agg(F.sum("s").alias("s"), F.sum("n").alias("n")), "boundary-rows")
    edge = state.select(F.col("source").alias("src"), "cut", "there", F.least(
        F.col("there"), F.floor(F.col("budget") * F.col("there") / F.col("s") + 0.5)).alias("wanted"))
    return goal.join(edge, F.col("source").eqNullSafe(F.col("src")), "left").withColumn(
        "whole", (F.col("target") > F.col("source_size")).cast("long")).drop("src")


def copies(rows: DataFrame, thr: DataFrame) -> DataFrame:
    """``rows`` (any columns, with source key ``src_key``, ``h`` and ``size``) joined to ``thr`` with ``copies``."""
    at = rows.join(thr, F.col("src_key").eqNullSafe(F.col("source_key")))
    tied = (F.col("h") == F.col("cut")) & (F.col("there") > 1) & (F.col("wanted") > 0) & (F.col("wanted") < F.col("there"))
    below = F.col("cut").isNull() | (F.col("h") < F.col("cut")) | (
        (F.col("h") == F.col("cut")) & (F.col("wanted") >= F.col("there")))
    flat = at.withColumn("copies", F.col("whole") + F.coalesce(below, F.lit(False)).cast("long"))
    if thr.where("there > 1 and wanted > 0 and wanted < there").isEmpty():
        return flat
    hot = stored(at.where(tied).withColumn("at", F.monotonically_increasing_id()).withColumn(
        "part", F.shiftright("at", 33)), "ties")
    key = ["src_key", "part"]
    before = hot.groupBy(*key).count().withColumn("before", F.coalesce(F.sum("count").over(
        W.Window.partitionBy("src_key").orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)))
    before = before.select(F.col("src_key").alias("k"), F.col("part").alias("p"), "before")
    hot = hot.withColumn("nth", F.row_number().over(W.Window.partitionBy(*key).orderBy("at"))).join(
        before, F.col("src_key").eqNullSafe(F.col("k")) & (F.col("part") == F.col("p")))
    hot = hot.withColumn("copies", F.col("whole") + (F.col("nth") + F.col("before") <= F.col("wanted")).cast("long"))
    return flat.where(~F.coalesce(tied, F.lit(False))).unionByName(hot.select(*flat.columns))


def _hash(doc_id, text):
    return F.xxhash64(F.lit("mix"), doc_id, text)


def mix_plan(sized: DataFrame, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """Thresholds by source for rows (source, size, h); the source column is named ``source_key``."""
    goal = targets(sized, weights, share)
    return stored(thresholds(sized, goal).withColumnRenamed("source", "source_key"), "thresholds")


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row per row of ``docs``."""
    sized = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                               _hash(F.col("doc_id"), F.col("text")).alias("h")), "sizes")
    out = copies(sized.withColumnRenamed("source", "src_key"), mix_plan(sized, weights, share))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """The documents of the mix, each 0, 1 or 2 times, with the columns of ``docs``."""
    whole = fresh(docs, "whole_row")
    rows = docs.select(F.col("source").alias("src_key"), word_count(F.col("text")).alias("size"),
                       _hash(F.col("doc_id"), F.col("text")).alias("h"),
                       F.struct(*[quoted(c) for c in docs.columns]).alias(whole))
    sized = stored(rows.select(F.col("src_key").alias("source"), "size", "h"), "sizes")
    out = copies(rows, mix_plan(sized, weights, share)).where("copies > 0")
    return out.select(whole, F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(f"{whole}.*")
