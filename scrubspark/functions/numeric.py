"""Column-level numeric helpers: the text-to-number rule and type classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The accepted number grammar (decimal with optional exponent,
# surrounding blanks allowed) and the accepted infinity spellings.  Anything
# else counts as "does not parse" (thousands separators, hex, booleans, nan).
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
INFINITY_PATTERN = r"^\s*[+-]?(?i:inf|infinity)\s*$"


def is_numeric_type(dt: T.DataType) -> bool:
    """Numeric in the profiler's sense: any Spark NumericType, bool excluded."""
    return isinstance(dt, T.NumericType)


def is_text_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.VarcharType, T.CharType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_text_type(f.dataType)]


def parse_number(c: Column | str, dtype: T.DataType | None = None) -> Column:
    """Text to double, NULL when the text is not a number.

    Numeric inputs are only cast.  Text must match ``NUMBER_PATTERN`` (or an
    infinity spelling) before ``try_cast`` sees it, so engine-specific
    spellings such as ``1.0d`` or ``1_000`` never parse.
    """
    col = F.col(c) if isinstance(c, str) else c
    if dtype is not None and is_numeric_type(dtype):
        return col.cast("double")
    s = col.cast("string")
    return (
        F.when(s.rlike(NUMBER_PATTERN), F.trim(s).try_cast("double"))
        .when(s.rlike(INFINITY_PATTERN),
              F.when(F.trim(s).startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
    )


def nan_to_null(c: Column) -> Column:
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def sql_parse_number(expr: str) -> str:
    """The same rule as ``parse_number`` written for a generic SQL engine (used by oracles)."""
    return (f"CASE WHEN regexp_matches(CAST({expr} AS VARCHAR), '{NUMBER_PATTERN}') "
            f"THEN TRY_CAST(trim(CAST({expr} AS VARCHAR)) AS DOUBLE) "
            f"WHEN regexp_matches(CAST({expr} AS VARCHAR), '{INFINITY_PATTERN}') "
            f"THEN CASE WHEN starts_with(trim(CAST({expr} AS VARCHAR)), '-') "
            f"THEN '-inf'::DOUBLE ELSE 'inf'::DOUBLE END END")
