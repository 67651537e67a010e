"""The profile of a growing table (F1-F13): a stored state that new files are merged into.

The state of a set of rows is a few figures per column: counts, least and greatest value, exact sums of the values and
their squares (fractions, see ``exact_sums``), a KLL sketch of the values and an HLL sketch of the distinct ones.  A column
with up to ``keep`` distinct values also has its value counts.  States of disjoint sets of rows merge into the state of
their union, whatever their order, so ``update`` reads only the files that the state does not cover yet.

What is exact: row, value and NULL counts, extremes, mean, deviation and parse rate always; distinct count, quartiles
and outlier share of a column while its value counts are kept.  The others come from the sketches, with an error in
ranks of ``stats.rank_error(SKETCH_K)`` and one of about 1.6 % in distinct counts.  ``exact`` in the profile names, per
column, which of these three are exact.  Whether value counts are kept follows from the exact number of distinct
values of all rows, not from the order of the files.  The duplicate rate of the header is from a sketch.

Stored under one folder of shared storage: a folder per version (``columns``, ``values``, ``files``) and ``commits``, to which
a finished version is appended last, so an update that dies leaves the state as it was.  One writer at a time.
A covered file that was rewritten or is gone is refused: its rows cannot be taken out again.

Defined cases: no rows give a state of zeros; NaN is NULL; -0.0 is 0.0; files without new rows change nothing but the
covered files; files whose columns or types differ are refused.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from fractions import Fraction

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from scrubspark.functions.numeric import is_numeric_type, is_text_type, parse_number
from scrubspark.functions.refusals import Refusal
from scrubspark.operators import dedup, profile, stats
from scrubspark.operators.clip import iqr_fences
from scrubspark.operators.exact_sums import exact_totals, fitted
from scrubspark.sources.tables import normalize

#: Distinct values up to which a column's value counts are kept.
KEEP = 100_000
#: A batch's value counts are not taken where the sketch has this many times ``keep`` distinct values (its error is 1.6 %).
SURELY_MORE = 1.2
#: Tasks that merge partial sketches before the last one.
MERGERS = 256
#: Parameter of the distinct sketches.
DISTINCT_K = 12
#: The row that stands for whole rows.
WHOLE = -1

COLUMNS = ("ordinal int, name string, dtype string, is_numeric boolean, n_rows long, n_values long, n_parsed long, vmin double, vmax double, "
           "total string, squares string, kept boolean")
STATE = COLUMNS + ", ranks binary, uniques binary"
VALUES = "ordinal int, value string, v double, n long"
FILES = "path string, size long, changed timestamp"


def _c(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _number(name: str) -> Column:
    return _c(name).cast("double") + F.lit(0.0)


def _identity(f: T.StructField) -> Column:
    """Text that two values share only if they are equal."""
    if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
        return (_c(f.name) + F.lit(0.0)).cast("string")
    if isinstance(f.dataType, T.BinaryType):
        return F.hex(_c(f.name))
    if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
        return F.when(_c(f.name).isNotNull(), F.to_json(F.struct(_c(f.name))))
    return _c(f.name).cast("string")


def _text(x: Fraction | None) -> str | None:
    return None if x is None else f"{x.numerator}/{x.denominator}"


@contextmanager
def measured(df: DataFrame, keep: int = KEEP):
    """The state of the rows of ``df``: its columns (``STATE``) and value counts (``VALUES``), held while they are used.

    Three jobs: all sketches and counts, the exact sums, and the value counts of the columns that may keep them.
    """
    df = normalize(df)
    fields = list(enumerate(df.schema.fields))
    numbers = {i: _number(f.name) for i, f in fields if is_numeric_type(f.dataType)}
    cells = [F.pmod(F.spark_partition_id(), F.lit(MERGERS)).alias("task"),
             F.concat_ws(",", *dedup.fingerprint(df.columns)).alias("row_print")]
    once = [F.count(F.lit(1)).alias("rows"), F.hll_sketch_agg("row_print", DISTINCT_K).alias("u_all")]
    again = [F.sum("rows").alias("rows"), F.hll_union_agg("u_all").alias("u_all")]
    for i, f in fields:
        cells.append(_identity(f).alias(f"t{i}"))
        once += [F.count(f"t{i}").alias(f"n{i}"), F.hll_sketch_agg(f"t{i}", DISTINCT_K).alias(f"u{i}")]
        again += [F.sum(f"n{i}").alias(f"n{i}"), F.hll_union_agg(f"u{i}").alias(f"u{i}")]
        if i in numbers:
            cells.append(numbers[i].alias(f"v{i}"))
            once += [F.min(f"v{i}").alias(f"lo{i}"), F.max(f"v{i}").alias(f"hi{i}"),
                     F.kll_sketch_agg_double(f"v{i}", stats.SKETCH_K).alias(f"s{i}")]
            again += [F.min(f"lo{i}").alias(f"lo{i}"), F.max(f"hi{i}").alias(f"hi{i}"), F.kll_merge_agg_double(f"s{i}").alias(f"s{i}")]
        elif is_text_type(f.dataType):
            cells.append(F.when(parse_number(_c(f.name)).isNotNull(), F.lit(1)).alias(f"p{i}"))
            once.append(F.count(f"p{i}").alias(f"p{i}"))
            again.append(F.sum(f"p{i}").alias(f"p{i}"))
    one = df.select(*cells).groupBy("task").agg(*once).agg(*again).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield _state(df, fields, numbers, one, keep)
    finally:
        one.unpersist()


def _state(df: DataFrame, fields: list, numbers: dict[int, Column], one: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
    small = [F.coalesce("rows", F.lit(0)).alias("rows")]
    for i, _ in fields:
        small += [F.coalesce(f"n{i}", F.lit(0)).alias(f"n{i}"), F.coalesce(F.hll_sketch_estimate(f"u{i}"), F.lit(0)).alias(f"d{i}")]
        small += [F.col(c) for c in (f"lo{i}", f"hi{i}") if c in one.columns]
        small += [F.coalesce(c, F.lit(0)).alias(c) for c in (f"p{i}",) if c in one.columns]
    row = one.select(*small).first()
    totals = exact_totals(df, numbers, {i: (row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"]) for i in numbers})
    kept = [(i, f) for i, f in fields if row[f"d{i}"] <= SURELY_MORE * keep]
    values = stats.local_frame(df.sparkSession, [], VALUES)
    if kept:
        # A value with a third of the rows is one row per task before the shuffle.
        pairs = [F.struct(F.lit(i).alias("ordinal"), _identity(f).alias("value"),
                          (numbers[i] if i in numbers else F.lit(None).cast("double")).alias("v")) for i, f in kept]
        values = df.select(F.inline(F.array(*pairs))).where("value is not null").groupBy("ordinal", "value", "v").agg(
            F.count(F.lit(1)).alias("n"))
    figures = [(i, f.name, f.dataType.simpleString(), i in numbers, row["rows"], row[f"n{i}"], row[f"p{i}"] if is_text_type(f.dataType) else None,
                row[f"lo{i}"] if i in numbers else None, row[f"hi{i}"] if i in numbers else None,
                *map(_text, totals.get(i, (None, None))), any(i == k for k, _ in kept)) for i, f in fields]
    figures.append((WHOLE, None, None, False, row["rows"], row["rows"], None, None, None, None, None, False))
    sketches = F.array(*[F.struct(F.lit(i).alias("ordinal"), (F.col(f"s{i}") if i in numbers else F.lit(None).cast("binary")).alias("ranks"),
                                  F.col(f"u{i}").alias("uniques")) for i, _ in fields],
                       F.struct(F.lit(WHOLE).alias("ordinal"), F.lit(None).cast("binary").alias("ranks"), F.col("u_all").alias("uniques")))
    state = stats.local_frame(df.sparkSession, figures, COLUMNS).join(one.select(F.inline(sketches)), "ordinal")
    return state.select(*T.StructType.fromDDL(STATE).names), values


def _added(states: DataFrame) -> list[tuple]:
    """The figures of several states added up per column; a few rows per state reach the driver, no sketch does."""
    by: dict[int, list] = {}
    for r in states.select(*T.StructType.fromDDL(COLUMNS).names).collect():
        by.setdefault(r["ordinal"], []).append(r)
    out = []
    for i, rows in sorted(by.items()):
        if len({(r["name"], r["dtype"]) for r in rows}) > 1 or len(rows) < len(by[WHOLE]):
            raise Refusal("unlike_columns", rows[0]["name"])
        with_values = [r for r in rows if r["n_values"]]
        lows = [r["vmin"] for r in with_values if r["vmin"] is not None]
        # A part with an infinity has no sums; the fit then follows from the extremes.
        whole = lows and all(r["total"] for r in with_values)
        sums = [_text(sum((Fraction(r[c]) for r in with_values), Fraction(0))) if whole else None for c in ("total", "squares")]
        parsed = [r["n_parsed"] for r in rows if r["n_parsed"] is not None]
        out.append((i, rows[0]["name"], rows[0]["dtype"], rows[0]["is_numeric"], sum(r["n_rows"] for r in rows), sum(r["n_values"] for r in rows),
                    sum(parsed) if parsed else None, min(lows) if lows else None,
                    max(r["vmax"] for r in with_values) if lows else None, *sums, all(r["kept"] for r in rows)))
    return out


@contextmanager
def merged(parts: list[tuple[DataFrame, DataFrame]], keep: int = KEEP):
    """The state of the rows of all ``parts`` together (columns, value counts), held while it is used."""
    states, values = parts[0]
    for s, v in parts[1:]:
        states, values = states.unionByName(s), values.unionByName(v)
    spark, rows = states.sparkSession, _added(states)
    kept = [r[0] for r in rows if r[-1]]
    values = values.where(F.col("ordinal").isin(kept)).groupBy("ordinal", "value", "v").agg(F.sum("n").alias("n"))
    values.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        distinct = {r["ordinal"]: r["d"] for r in values.groupBy("ordinal").agg(F.count(F.lit(1)).alias("d")).collect()}
        kept = [i for i in kept if distinct.get(i, 0) <= keep]
        rows = [(*r[:-1], r[0] in kept) for r in rows]
        sketches = states.groupBy("ordinal").agg(F.kll_merge_agg_double("ranks").alias("ranks"), F.hll_union_agg("uniques").alias("uniques"))
        state = stats.local_frame(spark, rows, COLUMNS).join(sketches, "ordinal").select(*T.StructType.fromDDL(STATE).names)
        yield state, values.where(F.col("ordinal").isin(kept)).select(*T.StructType.fromDDL(VALUES).names)
    finally:
        values.unpersist()


def _latest(spark: SparkSession, state_dir: str) -> tuple[int, str] | None:
    try:
        row = spark.read.schema("version long, folder string").parquet(f"{state_dir}/commits").orderBy(F.desc("version")).first()
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return None if row is None else (row["version"], f"{state_dir}/{row['folder']}")


def _part(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(STATE).parquet(f"{folder}/columns"), spark.read.schema(VALUES).parquet(f"{folder}/values")


def update(spark: SparkSession, state_dir: str, data_dir: str, keep: int = KEEP, names: str = "*.parquet") -> list[str]:
    """Bring the state in ``state_dir`` up to the Parquet files of ``data_dir``; the files read, which are the new ones."""
    state_dir = state_dir.rstrip("/")
    # A listing: without its content column this source opens no file.
    files = spark.read.format("binaryFile").option("pathGlobFilter", names).option("recursiveFileLookup", "true").load(
        data_dir).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("changed"))
    last = _latest(spark, state_dir)
    if last is None:
        fresh, parts, known = files, [], files.limit(0)
    else:
        parts, known = [_part(spark, last[1])], spark.read.schema(FILES).parquet(f"{last[1]}/files")
        lost = known.join(files, ["path", "size", "changed"], "left_anti").select("path").first()
        if lost is not None:
            raise Refusal("covered_file_changed", detail=lost["path"])
        fresh = files.join(known, "path", "left_anti")
    fresh = fresh.persist()
    try:
        # Paths only: Spark's own listing holds as many on the driver.
        paths = sorted(r["path"] for r in fresh.select("path").collect())
        if not paths:
            return []
        new = spark.read.option("basePath", data_dir).parquet(*paths)
        with stats.persisted(new), measured(new, keep) as part, merged([*parts, part], keep) as (state, values):
            folder = f"state-{uuid.uuid4().hex}"
            state.coalesce(1).write.parquet(f"{state_dir}/{folder}/columns")
            values.write.parquet(f"{state_dir}/{folder}/values")
            known.unionByName(fresh).write.parquet(f"{state_dir}/{folder}/files")
        version = 1 if last is None else last[0] + 1
        stats.local_frame(spark, [(version, folder)], "version long, folder string").coalesce(1).write.mode("append").parquet(
            f"{state_dir}/commits")
        return paths
    finally:
        fresh.unpersist()


def _quartiles(values: DataFrame, counts: dict[int, int]) -> dict[int, list[float]]:
    """Exact interpolated quartiles from value counts; a column has at most ``keep`` of them, so a window per column is bounded."""
    plans = {i: stats._plan(n, [0.25, 0.75]) for i, n in counts.items()}
    end = F.sum("n").over(Window.partitionBy("ordinal").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    wanted = stats.local_frame(values.sparkSession, [(i, r) for i, (_, ranks) in plans.items() for r in set(ranks)], "ordinal int, rank long")
    at = values.where("v is not null").select("ordinal", "v", "n", end.alias("end")).join(F.broadcast(wanted), "ordinal")
    got: dict[int, dict] = {i: {} for i in plans}
    for r in at.where("rank >= end - n and rank < end").select("ordinal", "rank", "v").collect():
        got[r["ordinal"]][r["rank"]] = r["v"]
    return {i: stats._interpolate(got[i], plan) for i, (plan, _) in plans.items()}


def fit(state: DataFrame, values: DataFrame) -> tuple[list[dict], dict]:
    """The profile (as ``profile.fit_profile`` gives it, with ``exact``) and the table header of a state."""
    rows = {r["ordinal"]: r for r in state.select(
        *T.StructType.fromDDL(COLUMNS).names, F.hll_sketch_estimate("uniques").alias("d"),
        F.when(F.col("vmin").isNotNull(), F.kll_sketch_get_quantile_double("ranks", F.array(F.lit(0.25), F.lit(0.75)))).alias("q")).collect()}
    whole = rows.pop(WHOLE)
    distinct = {r["ordinal"]: r["d"] for r in values.groupBy("ordinal").agg(F.count(F.lit(1)).alias("d")).collect()}
    numeric = {i: r for i, r in rows.items() if r["vmin"] is not None}
    kept = {i: r["n_values"] for i, r in numeric.items() if r["kept"]}
    quartiles = {i: tuple(r["q"]) for i, r in numeric.items()} | ({i: tuple(q) for i, q in _quartiles(values, kept).items()} if kept else {})
    fences = stats.local_frame(state.sparkSession, [(i, *iqr_fences(*q)) for i, q in quartiles.items()], "ordinal int, lo double, hi double")
    outside = {r["ordinal"]: r["n"] for r in values.join(F.broadcast(fences), "ordinal").where("v < lo or v > hi").groupBy(
        "ordinal").agg(F.sum("n").alias("n")).collect()}
    # Of a sketch: the share of values below and above the fences, which it takes as literals only.
    shares = [F.when(F.col("ordinal") == i, F.kll_sketch_get_rank_double("ranks", F.lit(lo)) + 1 - F.kll_sketch_get_rank_double("ranks", F.lit(hi)))
              for i, (lo, hi) in ((i, iqr_fences(*q)) for i, q in quartiles.items() if i not in kept)]
    beyond = {r["ordinal"]: r["x"] for r in state.select("ordinal", F.coalesce(*shares).alias("x")).collect()} if shares else {}
    prof = []
    for i, r in sorted(rows.items()):
        n, nn, number = r["n_rows"], r["n_values"], i in numeric
        mean, std = fitted(nn, r["vmin"], r["vmax"], None if r["total"] is None else (
            Fraction(r["total"]), Fraction(r["squares"]))) if number else (None, None)
        q1, q3 = quartiles.get(i, (None, None))
        share = (outside.get(i, 0) / nn if r["kept"] else beyond[i]) if number else None
        d = {"ordinal": i, "name": r["name"], "dtype": r["dtype"], "is_numeric": r["is_numeric"],
             "is_text": r["n_parsed"] is not None, "n_rows": n, "n_values": nn, "null_rate": (n - nn) / n if n else 0.0,
             "n_unique": distinct.get(i, 0) if r["kept"] else r["d"], "mean": mean, "std": std, "min": r["vmin"], "max": r["vmax"],
             "q1": q1, "q3": q3, "outlier_frac": share, "parse_rate": r["n_parsed"] / nn if nn and r["n_parsed"] is not None else None,
             "sample_values": None, "exact": ["n_unique", "quartiles", "outlier_frac"] if r["kept"] else []}
        d["flags"] = profile.flags(d)
        prof.append(d)
    n, d = whole["n_rows"], min(whole["n_rows"], whole["d"] or 0)
    return prof, {"n_rows": n, "n_cols": len(rows), "n_distinct": d, "duplicate_rate": (n - d) / n if n else 0.0}


def stored_profile(spark: SparkSession, state_dir: str) -> tuple[list[dict], dict]:
    """The profile and header of the state in ``state_dir``, without a look at the data."""
    last = _latest(spark, state_dir.rstrip("/"))
    if last is None:
        raise Refusal("no_state", detail=state_dir)
    return fit(*_part(spark, last[1]))


def frame(spark: SparkSession, prof: list[dict]) -> DataFrame:
    """One row per column: the profile's schema and ``exact``."""
    schema = T.StructType([*profile.PROFILE_SCHEMA.fields, T.StructField("exact", T.ArrayType(T.StringType()))])
    return stats.local_frame(spark, [tuple(d[f.name] for f in schema.fields) for d in prof], schema)
