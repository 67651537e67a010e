"""Column profiling.

``fit_profile`` computes every per-column figure in a fixed number of jobs,
independent of the number of rows:

* one global aggregate for null counts, numeric moments and text parse counts
  (with ``exact=False`` also HyperLogLog distinct counts);
* exact distinct counts by groups of ``DISTINCT_GROUP`` columns, so a row is
  expanded at most that many times and carries that many columns, however
  wide the table is; ``distinct=False`` leaves them out;
* exact quartiles per numeric column (``stats.quantiles``);
* one global aggregate counting values outside every column's IQR fences;
* optionally sample values (see ``sample_values``).

The result is a list of small dicts (one per column); ``profile`` turns it
into a DataFrame.  Only these per-column figures reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubspark.sources.tables import normalize
from scrubspark.functions.numeric import is_numeric_type, is_text_type, parse_number
from scrubspark.operators import stats
from scrubspark.operators.clip import iqr_fences
from scrubspark.operators import dedup
from scrubspark.operators.dedup import duplicate_counts

# Flag thresholds.
HEAVY_NULLS = 0.20
HAS_NULLS = 0.01
HEAVY_OUTLIERS = 0.05
TYPE_CHAOS = 0.7

# Columns whose exact distinct counts share one aggregate.
DISTINCT_GROUP = 4
# Rows looked at first for sample values.
SAMPLE_ROWS = 100

PROFILE_SCHEMA = T.StructType([
    T.StructField("ordinal", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("dtype", T.StringType()),
    T.StructField("is_numeric", T.BooleanType()),
    T.StructField("is_text", T.BooleanType()),
    T.StructField("n_rows", T.LongType()),
    T.StructField("n_values", T.LongType()),
    T.StructField("null_rate", T.DoubleType()),
    T.StructField("n_unique", T.LongType()),
    T.StructField("mean", T.DoubleType()),
    T.StructField("std", T.DoubleType()),
    T.StructField("min", T.DoubleType()),
    T.StructField("max", T.DoubleType()),
    T.StructField("q1", T.DoubleType()),
    T.StructField("q3", T.DoubleType()),
    T.StructField("outlier_frac", T.DoubleType()),
    T.StructField("parse_rate", T.DoubleType()),
    T.StructField("flags", T.ArrayType(T.StringType())),
    T.StructField("sample_values", T.ArrayType(T.StringType())),
])


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def fit_profile(df: DataFrame, order_by: list[str] | None = None, exact: bool = True,
                samples: int = 3) -> list[dict]:
    return fit_profile_and_header(df, order_by, exact, samples, header=False)[0]


def fit_profile_and_header(df: DataFrame, order_by: list[str] | None = None, exact: bool = True,
                           samples: int = 3, header: bool = True, columns: list[str] | None = None,
                           distinct: bool = True, median: bool = False) -> tuple[list[dict], dict | None]:
    """The profile and (with ``header``) the table header: distinct rows are counted by fingerprint
    (``dedup.fingerprint_groups``) beside the main aggregate, in its job.  ``columns`` limits the
    profile to those columns (the header still covers the whole row).
    ``distinct=False`` leaves ``n_unique`` NULL, for callers that do not read it;
    ``median=True`` adds each numeric column's median to the quantiles' job."""
    with stats.persisted(df):
        return _fit_profile(normalize(df), order_by, exact, samples, header, columns, distinct, median)


def distinct_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Exact distinct non-null values of each column: one aggregate for each group of
    ``DISTINCT_GROUP`` columns, all in one job."""
    if not columns:
        return {}
    parts = []
    for at in range(0, len(columns), DISTINCT_GROUP):
        group = columns[at:at + DISTINCT_GROUP]
        one = df.agg(*[F.count_distinct(_c(c)).alias(f"u{at + j}") for j, c in enumerate(group)])
        parts.append(one.select(F.lit(at).alias("at"), F.array(*one.columns).alias("n")))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionAll(p)
    return {columns[r["at"] + j]: n for r in union.collect() for j, n in enumerate(r["n"])}


def _fit_profile(df: DataFrame, order_by, exact, samples, header, columns=None, distinct=True, median=False
                 ) -> tuple[list[dict], dict | None]:
    fields = [(i, f) for i, f in enumerate(df.schema.fields) if columns is None or f.name in columns]
    exprs = [F.count(F.lit(1)).alias("__rows")]
    if header and not exact:
        exprs.append(F.approx_count_distinct(dedup.fingerprint(df.columns)[0]).alias("__distinct"))
    for i, f in fields:
        c = _c(f.name)
        exprs.append(F.count(c).alias(f"nn{i}"))
        if distinct and not exact:
            exprs.append(F.approx_count_distinct(c).alias(f"u{i}"))
        if is_numeric_type(f.dataType):
            v = c.cast("double")
            exprs += [F.avg(v).alias(f"mean{i}"), F.stddev_samp(v).alias(f"std{i}"),
                      F.min(v).alias(f"min{i}"), F.max(v).alias(f"max{i}")]
        elif is_text_type(f.dataType):
            exprs.append(F.count(parse_number(c)).alias(f"p{i}"))
    main, n_distinct = df.agg(*exprs), None
    if header and exact:
        with dedup.held(dedup.fingerprint_groups(df, df.columns)) as groups:
            row = stats.side_by_side(main, dedup.group_totals(groups)).first()
            n_distinct = dedup.distinct_rows(df, df.columns, groups, row)
    else:
        row = main.first()
    unique = {}
    if distinct:
        unique = (distinct_counts(df, [f.name for _, f in fields]) if exact
                  else {f.name: row[f"u{i}"] for i, f in fields})
    n_rows = row["__rows"]
    prof = []
    for i, f in fields:
        nn = row[f"nn{i}"]
        d = {"ordinal": i, "name": f.name, "dtype": f.dataType.simpleString(),
             "is_numeric": is_numeric_type(f.dataType), "is_text": is_text_type(f.dataType),
             "n_rows": n_rows, "n_values": nn,
             "null_rate": (n_rows - nn) / n_rows if n_rows else 0.0,
             "n_unique": unique.get(f.name), "mean": None, "std": None, "min": None, "max": None,
             "q1": None, "q3": None, "outlier_frac": None, "parse_rate": None,
             "flags": [], "sample_values": None}
        if d["is_numeric"] and nn > 0:
            d.update(mean=row[f"mean{i}"], std=0.0 if nn == 1 else row[f"std{i}"],
                     min=row[f"min{i}"], max=row[f"max{i}"])
        if d["is_text"] and nn > 0:
            d["parse_rate"] = row[f"p{i}"] / nn
        prof.append(d)
    with_values = [d for d in prof if d["is_numeric"] and d["n_values"] > 0]
    if with_values:
        qs = stats.quantiles_many(df, [d["name"] for d in with_values], [0.25, 0.5, 0.75] if median else [0.25, 0.75],
                                  exact=exact, counts={d["name"]: d["n_values"] for d in with_values})
        for d in with_values:
            d["q1"], d["q3"] = qs[d["name"]][0], qs[d["name"]][-1]
            d["median"] = qs[d["name"]][1] if median else None
    numeric = [d for d in prof if d["q1"] is not None]
    if numeric:
        oexprs = []
        for d in numeric:
            lo, hi = iqr_fences(d["q1"], d["q3"])
            x = _c(d["name"]).cast("double")
            oexprs.append(F.count(F.when((x < F.lit(lo)) | (x > F.lit(hi)), 1)).alias(f"o{d['ordinal']}"))
        orow = df.agg(*oexprs).first()
        for d in numeric:
            d["n_outliers"] = orow[f"o{d['ordinal']}"]
            d["outlier_frac"] = d["n_outliers"] / d["n_values"]
    for d in prof:
        d["flags"] = flags(d)
    if order_by and samples:
        got = sample_values(df, order_by, samples)
        for d in prof:
            d["sample_values"] = got.get(d["name"], [])
    head = None
    if header:
        distinct = n_distinct if exact else row["__distinct"]
        head = {"n_rows": n_rows, "n_cols": len(df.schema.fields), "n_distinct": distinct,
                "duplicate_rate": 0.0 if n_rows == 0 else (n_rows - distinct) / n_rows}
    return prof, head


def flags(d: dict) -> list[str]:
    """what stands out in one column's figures."""
    marks = (("heavy_nulls", d["null_rate"] > HEAVY_NULLS), ("has_nulls", d["null_rate"] > HAS_NULLS),
             ("heavy_outliers", (d["outlier_frac"] or 0) > HEAVY_OUTLIERS), ("type_chaos", (d["parse_rate"] or 0) > TYPE_CHAOS))
    return [name for name, met in marks if met]


def sample_values_frame(df: DataFrame, order_by: list[str], n: int = 3) -> DataFrame:
    """(name, sample_values): the first ``n`` non-null values of every column by ``order_by``."""
    got = sample_values(df, order_by, n)
    return stats.local_frame(df.sparkSession, [(k, v) for k, v in got.items() if v],
                             "name string, sample_values array<string>")


def _first_values(keys: list[str], column: str, n: int) -> Column:
    cells = F.array_sort(F.collect_list(F.when(_c(column).isNotNull(), F.struct(*keys, _c(column).alias("val")))))
    return F.transform(F.slice(cells, 1, n), lambda s: s["val"]).alias(column)


def sample_values(df: DataFrame, order_by: list[str], n: int = 3) -> dict[str, list[str]]:
    """The first ``n`` non-null values, as text, of every column by ``order_by``.

    The first ``SAMPLE_ROWS`` rows serve every column that has ``n`` values among
    them; each other column gets a top-``n`` of its own over two pruned columns.
    A top-n keeps n rows per task, so no cell is sorted or moved besides.
    """
    with stats.persisted(df):
        return _sample_values(df, order_by, n)


def _sample_values(df, order_by, n):
    names = [f.name for f in df.schema.fields]
    keys = [f"k{i}" for i in range(len(order_by))]
    okeys = [_c(o).alias(k) for o, k in zip(order_by, keys)]
    at_most = max(SAMPLE_ROWS, n)
    head = df.select(*okeys, *[_c(c).cast("string").alias(f"c{i}") for i, c in enumerate(names)])
    head = head.orderBy(*keys).limit(at_most)
    row = head.agg(F.count(F.lit(1)).alias("rows"), *[_first_values(keys, f"c{i}", n) for i in range(len(names))]).first()
    out = {c: list(row[f"c{i}"]) for i, c in enumerate(names)}
    tops = []
    for i, c in enumerate(names):
        if len(out[c]) < n and row["rows"] == at_most:
            top = df.where(_c(c).isNotNull()).select(*okeys, _c(c).cast("string").alias("val")).orderBy(*keys).limit(n)
            tops.append(top.agg(_first_values(keys, "val", n)).select(F.lit(i).alias("i"), "val"))
    if tops:
        union = tops[0]
        for t in tops[1:]:
            union = union.unionAll(t)
        out.update({names[r["i"]]: list(r["val"]) for r in union.collect()})
    return out


def profile(df: DataFrame, order_by: list[str] | None = None, exact: bool = True,
            prof: list[dict] | None = None) -> DataFrame:
    """F1-F13 as a DataFrame, one row per column of ``df``."""
    prof = prof if prof is not None else fit_profile(df, order_by, exact)
    return stats.local_frame(df.sparkSession, [tuple(d[f.name] for f in PROFILE_SCHEMA.fields) for d in prof],
                             PROFILE_SCHEMA)


def table_header(df: DataFrame) -> DataFrame:
    """n_rows, n_cols and duplicate_rate of ``df`` as one row (one job)."""
    return header_frame(df.sparkSession, fit_header(df))


def fit_header(df: DataFrame) -> dict:
    rows, distinct = duplicate_counts(df)
    return {"n_rows": rows, "n_cols": len(df.columns),
            "duplicate_rate": 0.0 if rows == 0 else (rows - distinct) / rows}


def header_frame(spark: SparkSession, h: dict) -> DataFrame:
    schema = "n_rows bigint, n_cols int, duplicate_rate double"
    return stats.local_frame(spark, [(h["n_rows"], h["n_cols"], h["duplicate_rate"])], schema)


def profile_lines(profile_df: DataFrame) -> DataFrame:
    """one text line per column, e.g.
    ``- price [double] nulls=21.4% unique=11690 | mean=.., std=.., min=.., max=.. flags=[heavy_nulls]``."""
    p = profile_df
    stats_txt = F.when(F.col("mean").isNotNull(), F.format_string(
        " | mean=%.2f, std=%.2f, min=%.2f, max=%.2f",
        F.round("mean", 2), F.round("std", 2), F.round("min", 2), F.round("max", 2))).otherwise(F.lit(""))
    flags_txt = F.when(F.size("flags") > 0, F.array_join("flags", ", ")).otherwise(F.lit("clean"))
    line = F.concat(F.lit("- "), F.col("name"), F.lit(" ["), F.col("dtype"), F.lit("] nulls="),
                    F.format_string("%.1f%%", F.round(F.col("null_rate") * 100, 1)),
                    F.lit(" unique="), F.col("n_unique").cast("string"), stats_txt,
                    F.lit(" flags=["), flags_txt, F.lit("]"))
    return p.select("ordinal", "name", line.alias("line"))


def header_lines(header_df: DataFrame, quality_df: DataFrame) -> DataFrame:
    """F14 header: ``Rows: n | Cols: c | Duplicate rate: x%`` and the quality line.

    Scores are printed with the 4 places they are rounded to, so the text is
    exact on every engine.
    """
    j = stats.side_by_side(header_df, quality_df)
    rows_line = F.concat(F.lit("Rows: "), F.col("n_rows").cast("string"), F.lit(" | Cols: "),
                         F.col("n_cols").cast("string"), F.lit(" | Duplicate rate: "),
                         F.format_string("%.1f%%", F.round(F.col("duplicate_rate") * 100, 1)))
    q_line = F.format_string("Quality: overall=%.4f | null_score=%.4f | type_score=%.4f | "
                             "outlier_score=%.4f | dup_score=%.4f", "overall", "null_score", "type_score",
                             "outlier_score", "dup_score")
    return j.select(F.inline(F.array(F.struct(F.lit(1).alias("line_no"), rows_line.alias("line")),
                                     F.struct(F.lit(2).alias("line_no"), q_line.alias("line")))))
