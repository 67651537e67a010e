"""Type repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubspark.functions.refusals import Refusal
from scrubspark.functions.numeric import parse_number

# Accepted target type names and their Spark types.
INT_TARGETS = ("int64", "int32", "int")
FLOAT_TARGETS = ("float64", "float32", "float")
STR_TARGETS = ("str", "string", "object")
TIME_TARGETS = ("datetime64", "datetime")
OTHER_TARGETS = {"bool": "boolean", "boolean": "boolean"}


def target_type(target: str) -> str:
    if target in INT_TARGETS:
        return "bigint"
    if target in FLOAT_TARGETS:
        return "double"
    if target in STR_TARGETS:
        return "string"
    if target in TIME_TARGETS:
        return "timestamp_ntz"
    if target in OTHER_TARGETS:
        return OTHER_TARGETS[target]
    raise Refusal("unknown_type", detail=repr(target))


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def fractional_count(df: DataFrame, col: str) -> int:
    """Rows whose parsed value is not a whole finite number (C8 check, one job)."""
    x = parse_number(_c(col), df.schema[col].dataType)
    bad = x.isNotNull() & (F.isnan(x) | (F.abs(x) == F.lit(float("inf"))) | (x != F.floor(x)))
    return int(df.agg(F.count(F.when(bad, 1)).alias("n")).first()["n"])


def cast_expr(df: DataFrame, col: str, target: str, null_text: str | None = None,
              fmt: str | None = None) -> Column:
    """The converted column for ``target`` (no data check)."""
    dt = df.schema[col].dataType
    c = _c(col)
    kind = target_type(target)
    if kind == "bigint":
        if isinstance(dt, (T.IntegralType, T.BooleanType)):
            return c.cast("bigint")
        if isinstance(dt, T.StringType):
            # Whole numbers past 2^53 must not go through double.
            whole = F.trim(c)
            return F.when(whole.rlike(r"^[+-]?[0-9]+$"), whole.try_cast("bigint")).otherwise(
                parse_number(c, dt).cast("bigint"))
        return parse_number(c, dt).cast("bigint")
    if kind == "double":
        return parse_number(c, dt)
    if kind == "string":
        s = c.cast("string")
        return s if null_text is None else F.coalesce(s, F.lit(null_text))
    if kind == "timestamp_ntz":
        if fmt:
            return F.try_to_timestamp(c.cast("string"), F.lit(fmt)).cast("timestamp_ntz")
        return c.cast("string").try_cast("timestamp_ntz")
    return c.try_cast(kind)


def fix_dtype(df: DataFrame, col: str, target: str, null_text: str | None = None,
              fmt: str | None = None, check: bool = True) -> DataFrame:
    """Convert ``col`` to ``target``; unparseable values become NULL.

    An integer target with any fractional value fails the whole action (the
    table is left as it was), after one counting job.
    """
    if col not in df.columns:
        raise Refusal("absent_column", col)
    if target_type(target) == "bigint" and check:
        n = fractional_count(df, col)
        if n:
            raise Refusal("fractional", col, f"{n} values are not whole, {target} would lose them")
    return df.withColumn(col, cast_expr(df, col, target, null_text, fmt))
