"""Duplicate removal (C6, C7) and duplicate rates."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scrubspark.functions.refusals import Refusal
from scrubspark.operators import stats


def _cols(names):
    return [F.col(f"`{n}`") for n in names]


def remove_duplicates(df: DataFrame, subset: list[str] | None = None,
                      order_by: list[str] | None = None) -> DataFrame:
    """Keep one row per distinct row (or per distinct ``subset``).

    Whole-row duplicates are identical, so any copy may stay: a hash
    aggregate with map-side combine, which collapses a hot duplicate group
    before the shuffle.  With ``subset`` the row kept is the first by
    ``order_by``; ``row_number() = 1`` lets Spark add a partial
    WindowGroupLimit before the shuffle, so each map task sends at most one
    row per key even when one key holds a third of the table.
    """
    if subset is None:
        return df.dropDuplicates()
    missing = [c for c in subset if c not in df.columns]
    if missing:
        raise Refusal("absent_column", ", ".join(missing))
    if not order_by:
        raise Refusal("no_order", detail="the first row of a subset needs order_by")
    w = Window.partitionBy(*_cols(subset)).orderBy(*_cols(order_by))
    return (df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn"))


#: Fingerprints (16 bytes each, their number known) that are broadcast to find the rows that share them.
BROADCAST_SHARED = 500_000
#: Size up to which duplicates are counted by whole rows.
WHOLE_ROW_BYTES = 64 << 20
#: Salts of the two halves of a fingerprint.
HALVES = (11, 23)


def cell_hash(name: str, place: int, half: int) -> str:
    """SQL for 64 bits of a cell; its place keeps equal cells of two columns apart, and NULL differs from every value."""
    c = "`" + name.replace("`", "``") + "`"
    return f"xxhash64({half}, {place}, isnull({c}), {c})"


def fingerprint(names: list[str]) -> list[Column]:
    """128 bits of a row over the columns ``names``, as two longs.

    Each half is the XOR of the cells' hashes, so a change of one cell changes it by that cell's old and new hash.
    """
    return [F.expr(" ^ ".join(["0L", *[cell_hash(c, place, half) for place, c in enumerate(names)]])) for half in HALVES]


def fingerprint_groups(df: DataFrame, names: list[str]) -> DataFrame:
    """(__fa, __fb, __fn): rows per fingerprint.  What is shuffled is 24 bytes per distinct row, however wide."""
    a, b = fingerprint(names)
    return df.select(a.alias("__fa"), b.alias("__fb")).groupBy("__fa", "__fb").agg(F.count(F.lit(1)).alias("__fn"))


@contextmanager
def held(groups: DataFrame):
    """Keep the ``groups`` while their totals, and then the shared ones among them, are read."""
    groups.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield groups
    finally:
        groups.unpersist()


def group_totals(groups: DataFrame) -> DataFrame:
    """One row: the rows, the fingerprints, and the fingerprints that more than one row has."""
    return groups.agg(F.coalesce(F.sum("__fn"), F.lit(0)).alias("__rows_all"), F.count(F.lit(1)).alias("__prints"),
                      F.count(F.when(F.col("__fn") > 1, 1)).alias("__shared"))


def distinct_rows(df: DataFrame, names: list[str], groups: DataFrame, totals) -> int:
    """Exact distinct rows from the ``groups`` of ``df`` and their ``group_totals``.

    A fingerprint of one row is one distinct row.  Rows that share a fingerprint may still differ: only they are
    grouped by their values, which costs nothing on a table without duplicates.
    """
    if not totals["__shared"]:
        return totals["__prints"]
    shared = groups.where("__fn > 1").select("__fa", "__fb")
    if totals["__shared"] <= BROADCAST_SHARED:
        shared = F.broadcast(shared)
    a, b = fingerprint(names)
    rows = df.select(*_cols(names), a.alias("__fa"), b.alias("__fb")).join(shared, ["__fa", "__fb"], "left_semi")
    # Copies meet in the map-side half of the aggregate, so a large group sends one row per task.
    apart = rows.groupBy("__fa", "__fb", *_cols(names)).agg(F.lit(1).alias("__one")).count()
    return totals["__prints"] - totals["__shared"] + apart


def duplicate_counts(df: DataFrame, subset: list[str] | None = None) -> tuple[int, int]:
    """(rows, distinct rows) over all columns or ``subset``, exact on either way.

    A table of up to ``WHOLE_ROW_BYTES`` is grouped by its values; beyond that, fingerprints are grouped (a shuffle
    of 24 bytes per distinct row), and then only the rows that share one.
    """
    names = list(subset or df.columns)
    size = stats.plan_bytes(df.select(*_cols(names)))
    if size is not None and size <= WHOLE_ROW_BYTES:
        g = df.groupBy(*_cols(names)).agg(F.count(F.lit(1)).alias("__n"))
        row = g.agg(F.sum("__n").alias("rows"), F.count(F.lit(1)).alias("distinct")).first()
        return int(row["rows"] or 0), int(row["distinct"] or 0)
    with held(fingerprint_groups(df, names)) as groups:
        totals = group_totals(groups).first()
        return int(totals["__rows_all"]), int(distinct_rows(df, names, groups, totals))


def duplicate_rate(df: DataFrame, subset: list[str] | None = None) -> float:
    rows, distinct = duplicate_counts(df, subset)
    return 0.0 if rows == 0 else (rows - distinct) / rows


class RowCounts:
    """The distinct rows of a table, kept up to date while single columns change.

    ``base`` has the rows per fingerprint of the table as it was first seen; a change of one column adds a table of
    differences: -1 for the old and +1 for the new fingerprint of each row that changed.  Only fingerprints in
    that table are counted again, against the few rows that ``base`` and the earlier differences have of them.
    """

    def __init__(self, df: DataFrame, names: list[str], totals: dict):
        self.names, self.rows, self.distinct = list(names), totals["rows"], totals["distinct"]
        self.parts = [fingerprint_groups(df, self.names).persist()]

    def change(self, df: DataFrame, column: str, apply) -> int:
        """Distinct rows after ``apply`` (frame -> frame, a projection that rewrites ``column``) on ``df``."""
        place = self.names.index(column)
        fa, fb = fingerprint(self.names)
        pair = df.select(*_cols(df.columns), fa.alias("__fa"), fb.alias("__fb"), F.col(f"`{column}`").alias("__old"))
        new = apply(pair)
        both = []
        for half, old in zip(HALVES, ("__fa", "__fb")):
            both.append((old, F.expr(f"{old} ^ {cell_hash('__old', place, half)} ^ {cell_hash(column, place, half)}")))
        moved = new.select(*[F.col(o) for o, _ in both], *[n.alias(f"{o}2") for o, n in both]).where("__fa <> __fa2 or __fb <> __fb2")
        steps = F.array(F.struct(F.col("__fa"), F.col("__fb"), F.lit(-1).cast("long").alias("__fn")),
                        F.struct(F.col("__fa2").alias("__fa"), F.col("__fb2").alias("__fb"), F.lit(1).cast("long").alias("__fn")))
        diff = moved.select(F.inline(steps)).groupBy("__fa", "__fb").agg(F.sum("__fn").alias("__fn")).where("__fn <> 0").persist()
        known = self.parts[0]
        for p in self.parts[1:]:
            known = known.unionAll(p)
        before = known.join(diff.select("__fa", "__fb"), ["__fa", "__fb"], "left_semi").unionAll(
            diff.select("__fa", "__fb", F.lit(0).cast("long"))).groupBy("__fa", "__fb").agg(F.sum("__fn").alias("__was"))
        row = before.join(diff, ["__fa", "__fb"]).agg(
            F.coalesce(F.sum((F.col("__was") + F.col("__fn") > 0).cast("long") - (F.col("__was") > 0).cast("long")), F.lit(0)).alias("d")).first()
        self.parts.append(diff)
        self.distinct += row["d"]
        return self.distinct

    def close(self) -> None:
        for p in self.parts:
            p.unpersist()
