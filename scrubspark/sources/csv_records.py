"""CSV files cut into records by many tasks, quoted line breaks included.

A line of the file says by the parity of its quote marks whether it changes between inside and outside of quotes
(a doubled quote mark changes twice).  Which state a byte range begins in is only known once the ranges before it
are read, so each range is summed up for both start states: the parity of its quotes, and its last line that begins
a record if it starts outside, or inside.  Those summaries, one row per range, are composed along each file by a
running parity; then every line knows its state and the line that its record began on.  A line that begins and ends
outside of quotes is a record as it stands; only the lines of longer records are put together, per record.

An unclosed quote makes the rest of its file one record, as with any CSV reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, row, value, odd): the physical lines; ``block`` is where the byte range starts in the file, and
    ``row`` ascends inside it; ``odd`` is 1 for a line with an odd number of quote marks."""
    t = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), "value")
    marks = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    return t.withColumn("odd", (marks % 2).cast("int"))


def _within(lines: DataFrame) -> DataFrame:
    """``lines`` and ``flips``: the parity of the quotes before the line in its range."""
    before = Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("flips", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)


def ranges(lines: DataFrame) -> DataFrame:
    """One row per byte range: ``open``, the state it starts in, and ``carry``, the (block, row) that the record
    reaching into it began on.  The lines' text does not move."""
    per = _within(lines.select("file", "block", "row", "odd")).groupBy("file", "block").agg(
        (F.sum("odd") % 2).alias("parity"), F.min("row").alias("first_row"),
        *[F.max(F.when(F.col("flips") == s, F.col("row"))).alias(f"last{s}") for s in (0, 1)])
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("open", F.coalesce(F.sum("parity").over(earlier), F.lit(0)) % 2)
    # From an open start, a line begins a record when the quotes before it have closed it: an odd number of flips.
    last = F.when(F.col("open") == 0, F.col("last0")).otherwise(F.col("last1"))
    begun = F.when(last.isNotNull(), F.struct("block", last.alias("row")))
    return per.select("file", "block", "open", "first_row", F.last(begun, ignorenulls=True).over(earlier).alias("carry"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """(record, is_header): the text of every record that is not empty; ``is_header`` marks each file's first."""
    lines = _lines(spark, path)
    t = _within(lines).join(ranges(lines), ["file", "block"])
    outside = F.col("flips") == F.col("open")
    upto = Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    own = F.last(F.when(outside, F.struct("block", "row")), ignorenulls=True).over(upto)
    t = t.select("file", "block", "row", "value", "odd", outside.alias("outside"), F.coalesce(own, F.col("carry")).alias("began"),
                 ((F.col("block") == 0) & (F.col("row") == F.col("first_row"))).alias("is_header"))
    alone = F.col("outside") & (F.col("odd") == 0)
    one = t.where(alone).select(F.col("value").alias("record"), "is_header")
    parts = F.array_sort(F.collect_list(F.struct("block", "row", "value")))
    more = t.where(~alone).groupBy("file", "began").agg(
        F.array_join(F.transform(parts, lambda p: p["value"]), "\n").alias("record"), F.max("is_header").alias("is_header"))
    out = one.unionByName(more.select("record", "is_header"))
    return out.select(F.regexp_replace("record", r"\A﻿|\r\z", "").alias("record"), "is_header").where("record <> ''")


def read_text_columns(spark: SparkSession, path: str) -> DataFrame:
    """The file's columns as text, by the names in its header."""
    plain = {"header": True, "inferSchema": False, "multiLine": True, "quote": '"', "escape": '"'}
    names = spark.read.options(**plain).csv(path).columns  # reads the header alone
    schema = ", ".join("`" + n.replace("`", "``") + "` string" for n in names)
    options = {"quote": '"', "escape": '"', "multiLine": "true"}
    cells = records(spark, path).where("not is_header").select(F.from_csv("record", schema, options).alias("r"))
    return cells.select([F.col("r").getField(n).alias(n) for n in names])
