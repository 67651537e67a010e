"""Grade specs for the fixture tables (FIXTURES.md B1, B2)."""

from __future__ import annotations

from scrubspark.operators.grade import GradeSpec

# Check weights of the two graded layouts.
WEIGHTS_WITH_DROP = {"null": 0.20, "type": 0.20, "outlier": 0.20, "dup": 0.15, "rules": 0.20}
WEIGHTS_WITH_PARSE = {"null": 0.20, "type": 0.15, "outlier": 0.15, "dup": 0.10, "parse": 0.10, "rules": 0.20}

ORDERS_SPEC = GradeSpec(
    null_cols=["o_totalprice", "o_orderpriority"],
    type_expect={"o_totalprice": "numeric", "qty_text": "numeric"},
    outlier_cols=["o_totalprice"],
    rules={"o_totalprice": (0, 600000), "qty_text": (0, 19)},
    irrelevant=["admin_note"],
    canonical={"o_orderpriority": "priority"},
    weights=WEIGHTS_WITH_DROP,
    max_steps=18,
)

EVENTS_SPEC = GradeSpec(
    null_cols=["value"],
    type_expect={"value": "numeric", "flag_text": "string", "ts_text": "timestamp_ntz"},
    outlier_cols=["value"],
    rules={"value": (-100, 1000)},
    parse_cols=["user_text"],
    irrelevant=["props"],
    weights=WEIGHTS_WITH_PARSE,
    max_steps=20,
)

# Weights of the layout without drop or parse checks.
WEIGHTS_PLAIN = {"null": 0.25, "type": 0.20, "outlier": 0.20, "dup": 0.15, "rules": 0.20}
LINEITEM_SPEC = GradeSpec(
    null_cols=["l_quantity"], type_expect={"l_quantity": "numeric", "l_discount": "numeric"},
    outlier_cols=["l_quantity"], rules={"l_quantity": (5, 45), "l_discount": (0, 0.05)}, weights=WEIGHTS_PLAIN)
# Weights above 1 in sum, so that the cap decides.
CAPPED_SPEC = GradeSpec(null_cols=["l_quantity"], type_expect={"l_quantity": "numeric"}, irrelevant=["no_such_column"],
                        weights={"null": 0.5, "type": 0.5})

# Column kinds of the fixture views, for generating oracle SQL.
DIRTY_ORDERS_COLS = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
                     ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"),
                     ("o_orderpriority", "string"), ("qty_text", "string"), ("admin_note", "string")]
DIRTY_EVENTS_COLS = [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"),
                     ("event_type", "string"), ("value", "double"), ("ts_text", "string"),
                     ("flag_text", "string")]
