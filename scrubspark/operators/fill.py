"""Null filling.

``fit_fill_value`` runs the small aggregate; ``fill_nulls`` applies it as a
literal in a projection.  Forward fill is a window over ranges of the
order (see ``forward_fill``).
"""

from __future__ import annotations

import math
import re
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from scrubspark.sources.tables import normalize
from scrubspark.functions import refusals
from scrubspark.functions.numeric import is_numeric_type, parse_number
from scrubspark.functions.refusals import Refusal
from scrubspark.operators import stats
from scrubspark.session import checkpoint_dir

STRATEGIES = ("mean", "median", "mode", "constant", "ffill")


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def constant_value(df: DataFrame, col: str, value=None):
    """``value`` (0 without one) as ``col`` can hold it; a constant its type cannot hold is refused.

    Text that reads as a number is that number in a numeric column, and a fraction turns an integer column
    double; NaN counts as missing, so it fills nothing.
    """
    dt = df.schema[col].dataType
    v = 0 if value is None else value
    if not is_numeric_type(dt):
        v = str(v)
    elif not isinstance(v, (int, float)):
        if re.fullmatch(r"\s*[+-]?[0-9]+\s*", str(v)):
            v = int(str(v))
        else:
            read = parse_number(F.col("v"), T.StringType()).alias("v")
            v = stats.local_frame(df.sparkSession, [(str(v),)], "v string").select(read).first()["v"]
    if isinstance(v, float) and not isinstance(dt, T.DecimalType):
        held = None if math.isnan(v) else v
    else:
        # Folded into the plan: no job.
        text = F.col("v").try_cast(dt)
        held = None if v is None else stats.local_frame(df.sparkSession, [(str(v),)], "v string").select(text.alias("v")).first()["v"]
    if held is None:
        raise Refusal("unfit_constant", col, f"{value!r} as {dt.simpleString()}")
    return v


def fit_fill_value(df: DataFrame, col: str, strategy: str = "mean", value=None, exact: bool = True,
                   n_values: int | None = None):
    """The literal a fill would use (C1-C4); refused when there is none."""
    refusals.one_of("unknown_strategy", strategy, [s for s in STRATEGIES if s != "ffill"], col)
    refusals.present(df.schema, col)
    if strategy in ("mean", "median"):
        refusals.numeric(df.schema, col)
    if strategy == "mean":
        v = stats.moments(df, [col])[col]["mean"]
    elif strategy == "median":
        v = stats.quantiles(df, col, [0.5], exact=exact, n=n_values)[0]
    elif strategy == "mode":
        v = stats.mode_value(df, col)
    else:
        v = constant_value(df, col, value)
    return some_value(v, col)


def some_value(v, col: str):
    """``v``, refused when the column had no values to take it from."""
    if v is None:
        raise Refusal("empty_column", col, "nothing to fit a value to")
    return v


def apply_fill(df: DataFrame, col: str, value) -> DataFrame:
    """Replace NULLs in ``col`` by ``value`` cast to the column's type.

    A float value makes an integer column double, so a mean of 1.5 stays 1.5.
    NaN counts as NULL.
    """
    dt = df.schema[col].dataType
    c = _c(col)
    if isinstance(value, float) and isinstance(dt, T.IntegralType):
        return df.withColumn(col, F.coalesce(c.cast("double"), F.lit(value)))
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        c = F.when(~F.isnan(c), c)
    return df.withColumn(col, F.coalesce(c, F.lit(value).try_cast(dt)))


def fill_nulls(df: DataFrame, col: str, strategy: str = "mean", value=None,
               order_by: list[str] | None = None, bucket: Column | None = None,
               exact: bool = True) -> DataFrame:
    """Fill NULLs of ``col`` by mean, median, mode, a constant, or forward fill."""
    if strategy == "ffill":
        if not order_by:
            raise Refusal("no_order", col, "rows have no order of their own")
        return forward_fill(normalize(df), col, order_by, bucket)
    df = normalize(df)
    return apply_fill(df, col, fit_fill_value(df, col, strategy, value, exact))


# Largest carry table (rows, one per range) that is broadcast; beyond it the join shuffles.
BROADCAST_CARRY = 200_000


def total_order(df: DataFrame, col: str, order_by: list[str]) -> list[Column]:
    """The one order of a forward fill: ``order_by``, then NULLs of ``col`` before its values, then a row hash.

    ``xxhash64`` skips NULLs, so their places are hashed too.  Rows still tied are equal rows, which any
    order fills alike.
    """
    cols = [_c(x) for x in df.columns]
    return [*[_c(o) for o in order_by], _c(col).isNotNull(), F.xxhash64(*cols, *[c.isNull() for c in cols])]


def order_ranges(df: DataFrame, order: list[Column], n_ranges: int | None = None) -> DataFrame:
    """``df`` cut into ranges of ``order`` numbered by ``__b``, written to the shared folder and read again.

    Spark samples the whole sort key, so any types, any number of columns, long common prefixes and tied
    values give ranges of about equal size; a random last key cuts equal rows as well.  Without
    ``n_ranges`` there are as many as the session has shuffle partitions, small ones coalesced.  Only a written
    table keeps the ranges as they are when a task is run again.
    """
    spark = df.sparkSession
    names = [f"__o{i}" for i in range(len(order))]
    t = df.select("*", *[o.alias(n) for o, n in zip(order, names)], F.rand(7).alias("__r"))
    keys = [*names, "__r"]
    t = t.repartitionByRange(n_ranges, *keys) if n_ranges else t.repartitionByRange(*keys)
    t = t.select(*[_c(x) for x in df.columns], F.spark_partition_id().alias("__b"))
    path = f"{checkpoint_dir(spark).rstrip('/')}/ranges-{uuid.uuid4().hex}"
    t.write.parquet(path)
    return spark.read.schema(t.schema).parquet(path)


def forward_fill(df: DataFrame, col: str, order_by: list[str], bucket: Column | str | None = "auto",
                 n_buckets: int | None = None, split_hot: bool = True) -> DataFrame:
    """Carry the last non-null value forward in ``total_order``.

    The table is cut into ranges of that order (``order_ranges``), and the work is split three ways:

    * inside a range: ``last(col, ignorenulls)`` over a window partitioned by range;
    * per range: its last non-null value by ``max_by`` (partial aggregation);
    * across ranges: a running ``last`` over one row per range, joined back.

    The filled values follow the total order alone, so they do not depend on the number of ranges, on the
    input's partitions or on ties.  A caller who already has buckets that never decrease along ``order_by``
    and are all small (for example ``date_trunc('day', ts)``) may pass ``bucket`` with ``split_hot=False``: no
    range exchange is made then, and a large bucket is one task's work.
    """
    refusals.present(df.schema, col)
    c = _c(col)
    order = total_order(df, col, order_by)
    if bucket is None or isinstance(bucket, str) or split_hot:
        t = order_ranges(df, order, n_buckets)
        ranges = n_buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    else:
        # A struct key is never NULL: the NULL bucket becomes (false, NULL) and sorts first.
        t = df.withColumn("__b", F.struct(bucket.isNotNull().alias("h"), bucket.alias("v")))
        ranges = None
    w = Window.partitionBy("__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last_per_range = t.groupBy("__b").agg(
        F.max_by(c, F.when(c.isNotNull(), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))).alias("__last"))
    carry_w = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carry = last_per_range.select("__b", F.last("__last", ignorenulls=True).over(carry_w).alias("__carry"))
    if ranges is not None and ranges <= BROADCAST_CARRY:
        # One row per range: a proven size, so the big side stays where it is.
        carry = F.broadcast(carry)
    out = t.withColumn("__local", F.last(c, ignorenulls=True).over(w)).join(carry, "__b", "left")
    return (out.withColumn(col, F.coalesce(F.col("__local"), F.col("__carry")))
            .select(*[_c(x) for x in df.columns]))
