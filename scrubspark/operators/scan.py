"""Running state along groups of any size: one segmented scan over ranges of the order.

A running value (a sum so far, a flag seen, the last value) is a window over its group, and so one task's work per group.
Where a group may be hot, ``cut`` first puts the rows into ranges of (keys, order), written once; ``scan`` then folds
inside each range and adds what the group's earlier ranges bring.  Every fold is associative, so the pieces combine.

Ranges follow one order that begins with the keys, so only the first and the last group of a range can reach into
another range.  The carry table is made from those groups' rows alone: at most two rows a range, whatever number of
groups there are, which is a proven size to broadcast.

The order of rows within a group is the caller's, then a hash of the whole row; rows still tied are equal rows.
NULL keys form a group, NULL values add nothing, an empty table stays empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scrubspark.functions.refusals import Refusal
from scrubspark.operators.fill import BROADCAST_CARRY, order_ranges

RANGE, TIE = "__b", "__tie"

# How values are folded, and how a range's own result takes what was carried to it.
_FOLDS = {
    "sum": (F.sum, lambda own, carried: F.coalesce(own + carried, own, carried)),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
}


@dataclass(frozen=True)
class Fold:
    """``value`` folded by ``how`` (sum, max, min) over the rows of a group: ``upto`` the row, those ``before`` it, or the ``whole``."""

    value: Column
    how: str
    reach: str = "upto"

    def __post_init__(self):
        if self.how not in _FOLDS or self.reach not in ("upto", "before", "whole"):
            raise Refusal("unknown_fold", detail=f"{self.how}, {self.reach}")


def _c(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def with_tie(df: DataFrame) -> DataFrame:
    """``df`` with a hash of the whole row, which orders rows that tie; ``xxhash64`` skips NULLs, so their places count too."""
    cols = [_c(c) for c in df.columns]
    return df.withColumn(TIE, F.xxhash64(*cols, *[c.isNull() for c in cols]))


def cut(df: DataFrame, keys: list[str], order: list[str], n_ranges: int | None = None) -> DataFrame:
    """``df`` (with its tie column) in written ranges of (keys, order, tie), numbered by ``__b``."""
    return order_ranges(df, [_c(c) for c in (*keys, *order, TIE)], n_ranges)


def hot_groups(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The keys (__k0, __k1, ...) of groups with more than ``most`` rows: one count per group, combined map-side."""
    return df.groupBy(*[_c(k).alias(f"__k{i}") for i, k in enumerate(keys)]).count().where(F.col("count") > most).drop("count")


def same_group(keys: list[str]) -> Column:
    """Condition that the rows' ``keys`` are those of a table with __k0, __k1, ... (NULL equals NULL)."""
    out = F.lit(True)
    for i, k in enumerate(keys):
        out = out & _c(k).eqNullSafe(F.col(f"__k{i}"))
    return out


def _carries(t: DataFrame, keys: list[str], folds: dict[str, Fold], n_ranges: int | None) -> DataFrame:
    """(__at, __k0.., __carry0..) for the first and last group of each range: what earlier ranges bring, or the whole group."""
    group = F.struct(*[_c(k).alias(f"__k{i}") for i, k in enumerate(keys)])
    ends = t.groupBy(F.col(RANGE).alias("__at")).agg(F.min(group).alias("__lo"), F.max(group).alias("__hi"))
    at_end = (F.col(RANGE) == F.col("__at")) & (group.eqNullSafe(F.col("__lo")) | group.eqNullSafe(F.col("__hi")))
    names = [f"__k{i}" for i in range(len(keys))]
    parts = t.join(_bounded(ends, n_ranges), at_end).groupBy("__at", *[_c(k).alias(n) for k, n in zip(keys, names)]).agg(
        *[_FOLDS[f.how][0](f.value).alias(f"__part{j}") for j, f in enumerate(folds.values())])
    group_rows = Window.partitionBy(*names)
    earlier = group_rows.orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("__at", *names, *[_FOLDS[f.how][0](f"__part{j}").over(group_rows if f.reach == "whole" else earlier)
                                       .alias(f"__carry{j}") for j, f in enumerate(folds.values())])


def _bounded(small: DataFrame, n_ranges: int | None) -> DataFrame:
    """A table of at most two rows a range: broadcast while ranges, as many as asked or one a shuffle partition, are few enough."""
    ranges = n_ranges or int(small.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return F.broadcast(small) if 2 * ranges <= BROADCAST_CARRY else small


def scan(t: DataFrame, keys: list[str], order: list[str], folds: dict[str, Fold], n_ranges: int | None = None) -> DataFrame:
    """``t`` (with its tie column) and one column per fold.

    A table that ``cut`` made (into ``n_ranges``) is folded by range and carried on; any other by windows over whole groups.
    """
    ranged = RANGE in t.columns
    group = Window.partitionBy(*([RANGE] if ranged else []), *[_c(k) for k in keys])
    along = group.orderBy(*[_c(c) for c in (*order, TIE)])
    frames = {"whole": group, "before": along.rowsBetween(Window.unboundedPreceding, -1),
              "upto": along.rowsBetween(Window.unboundedPreceding, 0)}
    own = {name: _FOLDS[f.how][0](f.value).over(frames[f.reach]) for name, f in folds.items()}
    if not ranged:
        return t.withColumns(own)
    carried = t.withColumns({f"__own{j}": c for j, c in enumerate(own.values())}).join(
        _bounded(_carries(t, keys, folds, n_ranges), n_ranges), (F.col(RANGE) == F.col("__at")) & same_group(keys), "left")
    joined = {name: _FOLDS[f.how][1](F.col(f"__own{j}"), F.col(f"__carry{j}")) if f.reach != "whole"
              else F.coalesce(F.col(f"__carry{j}"), F.col(f"__own{j}")) for j, (name, f) in enumerate(folds.items())}
    return carried.select(*[_c(c) for c in t.columns], *[c.alias(n) for n, c in joined.items()])
