"""Fitted statistics: the small numbers that drive cleaning transforms.

Every function here returns plain Python values (a handful of floats) and
never brings table rows to the driver.

Exact quantiles
---------------
Spark's exact ``percentile`` merges a value->count map of the whole column in
one task, which does not survive a large, high-cardinality column.  Here an
exact quantile takes at most three passes over the data, for all columns at
once:

1. one KLL sketch per column, of bounded size and merged as a tree, proposes
   for every target rank a bracket as wide as three times the sketch's error;
2. one job counts the rows below, at and between the ends of each bracket.  A
   rank on an end is answered; one outside, which the margin makes all but
   impossible, starts again with a wider bracket, so the result never depends
   on the sketch;
3. the rows strictly between the ends are read: up to ``limit`` of them become
   one sorted list in one task.  More are written to the shared folder, and the
   steps are repeated on that table, a small share of the column: a value
   more frequent than a bracket is wide is itself an end, so hot values do not
   stop brackets from shrinking.

Linear interpolation between neighbouring ranks follows the common
``q = v[lo] + (v[hi] - v[lo]) * (pos - lo)`` with ``pos = p * (n - 1)``.
"""

from __future__ import annotations

import math
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from scrubspark.functions.numeric import is_numeric_type
from scrubspark.functions.refusals import Refusal
from scrubspark.operators.exact_sums import mean_and_std
from scrubspark.session import checkpoint_dir

# Largest number of rows one final ranking task may hold.
QUANTILE_TASK_LIMIT = 1_000_000
APPROX_ACCURACY = 10_000
# Parameter of the sketches that propose brackets: about 160 KB each, an error of 0.036 % of the ranks.  Brackets are six
# errors wide; a parameter of some tens would make them as wide as the column.
SKETCH_K = 8192
SKETCH_MERGERS = 256


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def local_frame(spark: SparkSession, rows: list[tuple], schema) -> DataFrame:
    """A few driver rows as a relation in the plan itself: reading it back, or a projection of it, runs no job."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)
    cells = [[list(v.items()) if isinstance(v, dict) else v for v in col] for col in (zip(*rows) if rows else [()] * len(arrow))]
    table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cells, arrow)], schema=arrow)
    return spark.createDataFrame(table, schema)


def numeric_values(df: DataFrame, col: str) -> DataFrame:
    """Non-null, non-NaN values of a numeric column as ``v double``."""
    v = _c(col).cast("double")
    return df.select(v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))


def moments(df: DataFrame, cols: list[str]) -> dict[str, dict]:
    """Rows, nulls, count, mean, sample std, min, max for numeric ``cols`` in two jobs.

    Mean and deviation are bit-equal for any partitioning (see ``exact_sums``): a fit repeated gives the same fit.
    """
    vals = {c: F.when(~F.isnan(_c(c).cast("double")), _c(c).cast("double")) for c in cols}
    exprs = [F.count(F.lit(1)).alias("__rows")]
    for i, v in enumerate(vals.values()):
        exprs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"min{i}"), F.max(v).alias(f"max{i}")]
    row = df.agg(*exprs).first()
    fits = mean_and_std(df, vals, {c: (row[f"n{i}"], row[f"min{i}"], row[f"max{i}"]) for i, c in enumerate(cols)})
    return {c: {"rows": row["__rows"], "n": row[f"n{i}"], "nulls": row["__rows"] - row[f"n{i}"], "mean": fits[c][0],
                "std": fits[c][1], "min": row[f"min{i}"], "max": row[f"max{i}"]} for i, c in enumerate(cols)}


def mode_value(df: DataFrame, col: str):
    """Most frequent non-null value; ties go to the smallest value.

    Two distributed steps: a grouped count (partial aggregation map-side) and
    a global ``min`` over (-count, value), also merged map-side.  No step
    holds more than one group's count.
    """
    c = _c(col)
    counts = df.where(c.isNotNull()).groupBy(c.alias("v")).agg(F.count(F.lit(1)).alias("cnt"))
    best = counts.agg(F.min(F.struct((-F.col("cnt")).alias("neg"), F.col("v").alias("v"))).alias("b")).first()["b"]
    return None if best is None else best["v"]


def side_by_side(*frames: DataFrame) -> DataFrame:
    """The columns of several one-row frames (global aggregates) in one row.

    A union, in which each frame fills only its own columns, and one global
    aggregate that keeps the single non-null value of each column: no join.
    Column names must be distinct across the frames.
    """
    names = [c for f in frames for c in f.columns]
    u = frames[0]
    for f in frames[1:]:
        u = u.unionByName(f, allowMissingColumns=True)
    return u.agg(*[F.first(_c(c), ignorenulls=True).alias(c) for c in names])


_CHEAP_NODES = ("Relation", "Project", "Filter", "LocalRelation", "LogicalRDD")


def cheap_to_recompute(df: DataFrame) -> bool:
    """True when the optimized plan is only a file scan with filters and projections:
    re-reading the pruned columns then costs less than persisting the table."""
    try:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
    except AttributeError:  # a Spark Connect frame: no plan access, so persist
        return False
    for line in plan.splitlines():
        node = line.lstrip(" :+-").split(" ")[0].split("[")[0]
        if node and node not in _CHEAP_NODES:
            return False
    return True


def plan_bytes(df: DataFrame) -> int | None:
    """The plan's own size estimate (no job); None without plan access."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except AttributeError:
        return None


@contextmanager
def persisted(df: DataFrame):
    """Keep ``df`` for a multi-pass fit when the caller has not cached it and it is
    not a plain scan (Spark ML's convention); blocks lost with an executor are
    recomputed from lineage."""
    if df.storageLevel == StorageLevel.NONE and not cheap_to_recompute(df):
        df.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            yield df
        finally:
            df.unpersist()
    else:
        yield df


def rank_error(k: int) -> float:
    """Rank error, as a share of all values, that a KLL sketch of parameter ``k`` keeps to in 99 % of cases."""
    return 2.296 / k ** 0.9723


def _quantile_sketches(df: DataFrame, columns: dict[int, Column], k: int) -> DataFrame:
    """One row with a sketch ``s<id>`` per column.

    Partial sketches are merged in ``SKETCH_MERGERS`` tasks before the last one, which so receives a fixed number
    of bounded sketches however many tasks read the data.
    """
    task = F.pmod(F.spark_partition_id(), F.lit(SKETCH_MERGERS)).alias("__task")
    partial = df.select(task, *[c.alias(f"v{i}") for i, c in columns.items()]).groupBy("__task").agg(
        *[F.kll_sketch_agg_double(f"v{i}", k).alias(f"s{i}") for i in columns])
    return partial.agg(*[F.kll_merge_agg_double(f"s{i}").alias(f"s{i}") for i in columns])


def _brackets(df: DataFrame, columns: dict[int, Column], wins: list[dict], margin: float) -> list[tuple[float, float]]:
    """(lo, hi) around the ranks of each window, from one pass."""
    def share(rank, n, off):
        return F.lit(min(1.0, max(0.0, (rank + 0.5) / n + off * (margin + 1.0 / n))))

    used = {w["k"]: columns[w["k"]] for w in wins}
    row = _quantile_sketches(df, used, SKETCH_K).select(*[
        F.kll_sketch_get_quantile_double(f"s{w['k']}", F.array(share(w["ranks"][0], w["n"], -1), share(w["ranks"][-1], w["n"], 1)))
        .alias(f"q{i}") for i, w in enumerate(wins)]).first()
    return [tuple(row[f"q{i}"]) for i in range(len(wins))]


def select_ranks_many(df: DataFrame, columns: dict[int, Column], targets: dict[int, tuple[int, list[int]]],
                      limit: int = QUANTILE_TASK_LIMIT) -> dict[int, dict[int, float]]:
    """Exact values at 0-based ranks, for several columns at once.

    ``columns`` maps an id to a double column of ``df`` (NULL where it does not
    count); ``targets`` maps the id to (count of values, ranks wanted).  Each
    bracket is an aggregate over its own column of the row as it lies, so the
    work is rows x brackets; only the values of the final small brackets become
    rows of their own.
    """
    out: dict[int, dict[int, float]] = {k: {} for k in targets}
    found, todo = [], []
    for k, (n, ranks) in targets.items():
        if n <= limit:
            # Small enough already: one window (one sorted list) serves every rank.
            found.append({"k": k, "ranks": sorted(set(ranks)), "lo": None, "hi": None, "offset": 0, "size": n})
            continue
        groups: list[list[int]] = []
        for r in sorted(set(ranks)):
            if groups and r - groups[-1][-1] <= 1:
                groups[-1].append(r)
            else:
                groups.append([r])
        todo += [{"k": k, "n": n, "ranks": g} for g in groups]
    margin = 3 * rank_error(SKETCH_K)
    while todo:
        ends = _brackets(df, columns, todo, margin)
        counts = []
        for i, (w, (lo, hi)) in enumerate(zip(todo, ends)):
            v = columns[w["k"]]
            counts += [F.count(F.when(c, 1)).alias(f"{name}{i}") for name, c in (
                ("below", v < F.lit(lo)), ("low", v == F.lit(lo)), ("in", (v > F.lit(lo)) & (v < F.lit(hi))), ("high", v == F.lit(hi)))]
        row, missed = df.agg(*counts).first(), []
        for i, (w, (lo, hi)) in enumerate(zip(todo, ends)):
            start = row[f"below{i}"] + row[f"low{i}"]
            end = start + row[f"in{i}"]
            last = start if lo == hi else end + row[f"high{i}"]
            if w["ranks"][0] < row[f"below{i}"] or w["ranks"][-1] >= last:
                missed.append(w)
                continue
            out[w["k"]].update({r: lo if r < start else hi for r in w["ranks"] if not start <= r < end})
            between = [r for r in w["ranks"] if start <= r < end]
            if between:
                found.append({"k": w["k"], "ranks": between, "lo": lo, "hi": hi, "offset": start, "size": row[f"in{i}"]})
        # A margin of one makes the ends the least and the greatest value.
        todo, margin = missed, min(1.0, 4 * margin)

    def members(ws):
        """(w, v): the values inside each of the numbered windows ``ws``."""
        cells = []
        for i, w in ws:
            v = columns[w["k"]]
            inside = v.isNotNull() if w["lo"] is None else (v > F.lit(w["lo"])) & (v < F.lit(w["hi"]))
            cells.append(F.when(inside, F.struct(F.lit(i).alias("w"), v.alias("v"))))
        return df.select(F.inline(F.array_compact(F.array(*cells))))

    small = [(i, w) for i, w in enumerate(found) if w["size"] <= limit]
    large = [(i, w) for i, w in enumerate(found) if w["size"] > limit]
    if small:
        # One job: each window (at most ``limit`` values) becomes one sorted
        # list in one task, and only the values at the wanted ranks return.
        lists = members(small).groupBy("w").agg(F.array_sort(F.collect_list("v")).alias("a"))
        picks = [F.when(F.col("w") == i, F.struct(F.lit(r).alias("r"),
                                                   F.element_at("a", r - w["offset"] + 1).alias("v")))
                 for i, w in small for r in w["ranks"]]
        for h in lists.select("w", F.array_compact(F.array(*picks)).alias("p")).collect():
            out[found[h["w"]]["k"]].update({p["r"]: p["v"] for p in h["p"]})
    if large:
        # Written once, so the data itself is not read again; each level leaves a small share of the last.
        path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/brackets-{uuid.uuid4().hex}"
        members(large).write.parquet(path)
        inner = df.sparkSession.read.schema("w int, v double").parquet(path)
        got = select_ranks_many(inner, {i: F.when(F.col("w") == i, F.col("v")) for i, _ in large},
                                {i: (w["size"], [r - w["offset"] for r in w["ranks"]]) for i, w in large}, limit)
        for i, w in large:
            out[w["k"]].update({r + w["offset"]: v for r, v in got[i].items()})
    return out


def select_ranks(values: DataFrame, n: int, ranks: list[int], limit: int = QUANTILE_TASK_LIMIT) -> dict[int, float]:
    """Exact values at 0-based ``ranks`` of the sorted column ``v`` of ``values``."""
    return select_ranks_many(values, {0: F.col("v")}, {0: (n, ranks)}, limit)[0]


def _plan(n: int, probs: list[float]):
    plan, ranks = [], []
    for p in probs:
        pos = p * (n - 1)
        lo, hi = math.floor(pos), math.ceil(pos)
        plan.append((lo, hi, pos - lo))
        ranks += [lo, hi]
    return plan, ranks


def _interpolate(got: dict[int, float], plan) -> list[float]:
    return [got[lo] if lo == hi else got[lo] + (got[hi] - got[lo]) * d for lo, hi, d in plan]


def quantiles(df: DataFrame, col: str, probs: list[float], exact: bool = True,
              n: int | None = None, limit: int = QUANTILE_TASK_LIMIT,
              accuracy: int = APPROX_ACCURACY) -> list[float | None]:
    """Linear-interpolated quantiles of a numeric column, NULLs and NaN ignored.

    ``exact=False`` returns ``percentile_approx`` values (one job, rank error
    at most n/accuracy) for callers that accept that.
    """
    return quantiles_many(df, [col], probs, exact, None if n is None else {col: n}, limit, accuracy)[col]


def quantiles_many(df: DataFrame, cols: list[str], probs: list[float], exact: bool = True,
                   counts: dict[str, int] | None = None, limit: int = QUANTILE_TASK_LIMIT,
                   accuracy: int = APPROX_ACCURACY) -> dict[str, list[float | None]]:
    """``quantiles`` for several numeric columns with one counting job and one final job."""
    for c in cols:
        if not is_numeric_type(df.schema[c].dataType):
            raise Refusal("wrong_type", c, "no number type")
    vals = {i: F.when(~F.isnan(_c(c).cast("double")), _c(c).cast("double")) for i, c in enumerate(cols)}
    if not exact:
        row = df.agg(*[F.percentile_approx(v, list(probs), accuracy).alias(f"q{i}") for i, v in vals.items()]).first()
        return {c: (list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * len(probs))
                for i, c in enumerate(cols)}
    if counts is None or any(c not in counts for c in cols):
        row = df.agg(*[F.count(v).alias(f"n{i}") for i, v in vals.items()]).first()
        counts = {c: row[f"n{i}"] for i, c in enumerate(cols)}
    plans, targets = {}, {}
    for i, c in enumerate(cols):
        if counts[c]:
            plans[c], ranks = _plan(counts[c], probs)
            targets[i] = (counts[c], ranks)
    got = select_ranks_many(df, vals, targets, limit) if targets else {}
    return {c: (_interpolate(got[i], plans[c]) if c in plans else [None] * len(probs))
            for i, c in enumerate(cols)}
