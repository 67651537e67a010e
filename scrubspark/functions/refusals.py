"""Why an action does not run, as data: a code, the column it is about and a detail."""

from __future__ import annotations

from pyspark.sql import types as T

from scrubspark.functions.numeric import is_numeric_type


class Refusal(ValueError):
    """An action's own refusal.  Faults of the cluster are other exceptions and propagate."""

    def __init__(self, code: str, column: str | None = None, detail: str = ""):
        self.code, self.column, self.detail = code, column, detail
        super().__init__(": ".join(x for x in (code, column, detail) if x))


def present(schema: T.StructType, column: str | None) -> None:
    if column is None or column == "":
        raise Refusal("no_column")
    if column not in schema.names:
        raise Refusal("absent_column", column)


def numeric(schema: T.StructType, column: str) -> None:
    present(schema, column)
    if not is_numeric_type(schema[column].dataType):
        raise Refusal("wrong_type", column, f"{schema[column].dataType.simpleString()} is no number type")


def one_of(code: str, value, allowed, column: str | None = None) -> None:
    if value not in allowed:
        raise Refusal(code, column, f"{value!r} is none of {', '.join(allowed)}")
