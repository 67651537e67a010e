"""Cleaning a stream with a plan fitted on a batch table.

Fitting needs whole-column statistics (medians, quartiles), which a stream
does not have; applying them does not.  ``fit_plan`` fits fills and clips on
a batch DataFrame, in order (each step fitted on the result of the previous
ones), and returns literal steps; ``apply_plan`` applies them to any
DataFrame, batch or streaming, as one projection.  ``dedup_stream`` is the
streaming form of whole-row de-duplication: state bounded by a watermark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubspark.operators import clip, fill


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def fit_plan(batch: DataFrame, steps: list[tuple], exact: bool = True) -> list[tuple]:
    """``steps``: ("fill", col, strategy[, value]) or ("clip", col, method).

    Returns literal steps ("fill", col, value) / ("clip", col, lo, hi)."""
    fitted = []
    current = batch
    for s in steps:
        if s[0] == "fill":
            value = fill.fit_fill_value(current, s[1], s[2], s[3] if len(s) > 3 else None, exact)
            fitted.append(("fill", s[1], value))
        elif s[0] == "clip":
            lo, hi = clip.fit_clip_bounds(current, s[1], s[2], exact=exact)
            fitted.append(("clip", s[1], lo, hi))
        else:
            raise ValueError(f"unknown step {s!r}")
        current = apply_plan(current, fitted[-1:])
    return fitted


def apply_plan(df: DataFrame, fitted: list[tuple]) -> DataFrame:
    out = df
    for s in fitted:
        if s[0] == "fill":
            out = fill.apply_fill(out, s[1], s[2])
        else:
            out = out.withColumn(s[1], clip.clip_expr(_c(s[1]), s[2], s[3]))
    return out


def dedup_stream(stream: DataFrame, event_time: str, delay: str, keys: list[str] | None = None) -> DataFrame:
    """Drop repeated rows that arrive within ``delay`` of each other (bounded state).

    Watermarks need a TIMESTAMP column; a TIMESTAMP_NTZ event time is read in
    the session time zone (UTC here) through a helper column.
    """
    keys = keys or stream.columns
    if stream.schema[event_time].dataType.simpleString() == "timestamp_ntz":
        t = stream.withColumn("__event_time", F.col(event_time).cast("timestamp"))
        return (t.withWatermark("__event_time", delay).dropDuplicatesWithinWatermark(keys)
                .drop("__event_time"))
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Drain all available input of ``stream`` into parquet files under ``path``
    and return them as a table.

    Both folders belong under the shared checkpoint folder.  The file sink
    commits each micro-batch through its metadata log, so a batch retried
    after an executor loss is written once, and reading ``path`` sees only
    committed files.  Nothing passes through the driver.
    """
    q = (stream.writeStream.format("parquet").option("path", path).outputMode("append")
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return stream.sparkSession.read.parquet(path)
