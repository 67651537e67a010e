"""Cleaning actions: the plan's unit of work."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import types as T

# The seven action types, in their declared order.
ACTION_TYPES = ("fill_nulls", "remove_duplicates", "fix_dtype", "clip_outliers",
                "rename_column", "drop_column", "done")
DEFAULT_CONFIDENCE = 0.5

ACTION_SCHEMA = T.StructType([
    T.StructField("action_type", T.StringType()),
    T.StructField("column", T.StringType()),
    T.StructField("params", T.MapType(T.StringType(), T.StringType())),
    T.StructField("confidence", T.DoubleType()),
])


@dataclass
class Action:
    action_type: str
    column: str | None = None
    params: dict = field(default_factory=dict)
    confidence: float = DEFAULT_CONFIDENCE

    def __post_init__(self):
        if self.action_type not in ACTION_TYPES:
            raise ValueError(f"unknown action_type '{self.action_type}'")
        if self.confidence is None:
            self.confidence = DEFAULT_CONFIDENCE
        if not 0.0 <= float(self.confidence) <= 1.0:
            raise ValueError("confidence must be within [0, 1]")
        if self.column:
            self.column = self.column.strip()

    def param(self, key, default=None):
        return self.params.get(key, default) if self.params else default

    def as_row(self):
        return (self.action_type, self.column,
                {str(k): (json.dumps(list(v)) if isinstance(v, (list, tuple)) else str(v))
                 for k, v in (self.params or {}).items()},
                float(self.confidence))

    @staticmethod
    def from_row(row) -> "Action":
        params = dict(row["params"] or {})
        if "subset" in params and isinstance(params["subset"], str):
            text = params["subset"]
            params["subset"] = json.loads(text) if text.startswith("[") else [s for s in text.split(",") if s]
        return Action(row["action_type"], row["column"], params, row["confidence"])
