"""Where two versions of a keyed table differ (V3, for a replay that does not verify).

A hash tree over ranges of an integer key.  A node is a range; its digest has, for the rows and for each column, the sum
of 128-bit hashes over its rows, of the key together with the cell, so equal multisets of rows give equal sums in any
order and on any partitioning.  One grouped aggregate takes both sides, the right one with a minus sign: a range
whose sums are all zero is equal and is not looked at again.  The others are cut into ``fanout`` ranges each, and
their rows alone are read, by a filter on the key that reaches the scan, until ranges are a key wide or too many
are open to go on narrowing.  Their rows are then summed per key.  Per level the driver holds the open ranges, at most
``most_open`` of them; no side is joined or sorted, and a repeated key is a sum like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubspark.functions.refusals import Refusal, present
from scrubspark.operators.dedup import HALVES
from scrubspark.operators.stats import local_frame

FANOUT, MOST_OPEN = 64, 1000


def _c(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _signed(left: DataFrame, right: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(k, s, h<i>a, h<i>b): the rows of both sides with sign and the hashes of their cells, a NULL key told by ``n``."""
    def side(df, sign):
        cells = [F.xxhash64(F.lit(half), F.lit(i), _c(key), _c(c).isNull(), _c(c)).cast("decimal(38,0)").alias(f"h{i}{x}")
                 for i, c in enumerate(names) for half, x in zip(HALVES, "ab")]
        return df.select(_c(key).cast("long").alias("k"), F.lit(sign).alias("s"), *cells)
    return side(left, 1).unionAll(side(right, -1))


def _sums(names: list[str]) -> list[Column]:
    sums = [F.sum(F.col("s") * F.col(f"h{i}{x}")).alias(f"h{i}{x}") for i in range(len(names)) for x in "ab"]
    return [F.count(F.when(F.col("s") > 0, 1)).alias("left_rows"), F.count(F.when(F.col("s") < 0, 1)).alias("right_rows"), *sums]


def _unequal(names: list[str]) -> Column:
    out = F.col("left_rows") != F.col("right_rows")
    for i in range(len(names)):
        out = out | (F.col(f"h{i}a") != 0) | (F.col(f"h{i}b") != 0)
    return out


def _inside(spans: list[tuple[int, int]]) -> Column:
    """The keys of ``spans``; neighbouring ones become one comparison."""
    joined: list[list[int]] = []
    for lo, hi in sorted(spans):
        if joined and lo <= joined[-1][1] + 1:
            joined[-1][1] = max(hi, joined[-1][1])
        else:
            joined.append([lo, hi])
    out = F.lit(False)
    for lo, hi in joined:
        out = out | F.col("k").between(lo, hi)
    return out


def open_ranges(signed: DataFrame, names: list[str], fanout: int = FANOUT, most_open: int = MOST_OPEN) -> list[tuple[int, int]]:
    """The smallest ranges (first key, last key) found in which the two sides differ; NULL keys are not among them."""
    ends = signed.agg(F.min("k").alias("lo"), F.max("k").alias("hi")).first()
    if ends["lo"] is None:
        return []
    lo, hi = ends["lo"], ends["hi"]
    width, spans = hi - lo + 1, [(lo, hi)]
    while True:
        inner = -(-width // fanout)
        # Ranges of a level share one width, counted from the least key, so a key's range is one division.
        at = F.floor((F.col("k").cast("decimal(38,0)") - F.lit(lo).cast("decimal(38,0)")) / F.lit(inner).cast("decimal(38,0)"))
        found = signed.where(_inside(spans)).groupBy(at.alias("at")).agg(*_sums(names)).where(_unequal(names)).select("at")
        got = [int(r["at"]) for r in found.limit(most_open + 1).collect()]
        if len(got) > most_open:
            return spans
        spans, width = [(lo + n * inner, min(hi, lo + (n + 1) * inner - 1)) for n in sorted(got)], inner
        if width == 1 or not spans:
            return spans


def differences(left: DataFrame, right: DataFrame, key: str, fanout: int = FANOUT, most_open: int = MOST_OPEN) -> DataFrame:
    """One row per key whose rows differ: ``key``, left_rows, right_rows, ``change`` (added, removed, changed) and the
    ``columns`` that differ (all of them for a key that one side lacks)."""
    for df in (left, right):
        present(df.schema, key)
        if not isinstance(df.schema[key].dataType, T.IntegralType):
            raise Refusal("wrong_type", key, "ranges need an integer key")
    if left.columns != right.columns:
        raise Refusal("unlike_columns", detail=", ".join(sorted(set(left.columns) ^ set(right.columns))) or "another order")
    names = [c for c in left.columns if c != key]
    signed = _signed(left, right, key, names)
    spans = open_ranges(signed, names, fanout, most_open)
    rows = signed.where(_inside(spans) | F.col("k").isNull()) if spans else signed.where("k is null")
    per = rows.groupBy("k").agg(*_sums(names)).where(_unequal(names))
    change = F.when(F.col("left_rows") == 0, "added").when(F.col("right_rows") == 0, "removed").otherwise("changed")
    apart = [F.when((F.col(f"h{i}a") != 0) | (F.col(f"h{i}b") != 0), F.lit(c)) for i, c in enumerate(names)]
    columns = F.array_compact(F.array(*apart)) if apart else F.expr("cast(array() as array<string>)")
    return per.select(F.col("k").alias(key), "left_rows", "right_rows", change.alias("change"), columns.alias("columns"))


def differing_ranges(left: DataFrame, right: DataFrame, key: str, fanout: int = FANOUT, most_open: int = MOST_OPEN) -> DataFrame:
    """(first_key, last_key) of the smallest ranges found in which the two sides differ."""
    names = [c for c in left.columns if c != key]
    spans = open_ranges(_signed(left, right, key, names), names, fanout, most_open)
    return local_frame(left.sparkSession, spans, "first_key long, last_key long")
