"""Outlier clipping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubspark.sources.tables import normalize
from scrubspark.functions import refusals
from scrubspark.operators import stats

METHODS = ("iqr", "zscore", "percentile")


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def iqr_fences(q1: float, q3: float, k: float = 1.5) -> tuple[float, float]:
    iqr = q3 - q1
    return q1 - k * iqr, q3 + k * iqr


def fit_clip_bounds(df: DataFrame, col: str, method: str = "iqr", threshold: float = 3.0,
                    lower_pct: float = 1, upper_pct: float = 99, exact: bool = True):
    """(lo, hi) for ``method``; IQR and percentile bounds use interpolated quantiles."""
    refusals.numeric(df.schema, col)
    if method == "iqr":
        q1, q3 = stats.quantiles(df, col, [0.25, 0.75], exact=exact)
        if q1 is None:
            return None, None
        return iqr_fences(q1, q3)
    if method == "zscore":
        m = stats.moments(df, [col])[col]
        if m["mean"] is None or m["std"] is None:
            return None, None
        t = float(threshold)
        return m["mean"] - t * m["std"], m["mean"] + t * m["std"]
    if method == "percentile":
        return tuple(stats.quantiles(df, col, [float(lower_pct) / 100, float(upper_pct) / 100], exact=exact))
    raise refusals.Refusal("unknown_method", col, repr(method))


def clip_expr(c: Column, lo, hi) -> Column:
    """Values strictly outside [lo, hi] move to the bound; NULL stays NULL.

    CASE, not greatest/least: those skip NULL and would fill it with a bound.
    """
    out = c.cast("double")
    if lo is None or hi is None:
        return out
    return F.when(out < F.lit(lo), F.lit(lo)).when(out > F.lit(hi), F.lit(hi)).otherwise(out)


def outlier_count_expr(c: Column, lo, hi) -> Column:
    x = c.cast("double")
    return F.count(F.when((x < F.lit(lo)) | (x > F.lit(hi)), 1))


def clip_outliers(df: DataFrame, col: str, method: str = "iqr", threshold: float = 3.0,
                  lower_pct: float = 1, upper_pct: float = 99, exact: bool = True) -> DataFrame:
    """Clip ``col`` to bounds fitted by ``method``; output is double."""
    df = normalize(df)
    lo, hi = fit_clip_bounds(df, col, method, threshold, lower_pct, upper_pct, exact)
    return df.withColumn(col, clip_expr(_c(col), lo, hi))
