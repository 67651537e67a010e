"""Schema edits (C16, C17): plan-time only, no job."""

from __future__ import annotations

from pyspark.sql import DataFrame

from scrubspark.functions.refusals import Refusal


def rename_column(df: DataFrame, col: str, new_name: str) -> DataFrame:
    if col not in df.columns:
        raise Refusal("absent_column", col)
    if not new_name:
        raise Refusal("no_parameter", col, "new_name")
    if new_name in df.columns:
        raise Refusal("taken_name", col, new_name)
    return df.withColumnRenamed(col, new_name)


def drop_column(df: DataFrame, col: str) -> DataFrame:
    if col not in df.columns:
        raise Refusal("absent_column", col)
    return df.drop(col)


def is_canonical(new_name: str, canonical: dict[str, str] | None) -> bool:
    """A rename earns the canonical flag when the new name is one of the map's values."""
    return bool(canonical) and new_name in set(canonical.values())


def is_irrelevant(col: str, irrelevant: list[str] | None) -> bool:
    return bool(irrelevant) and col in irrelevant
