"""Table quality scores (Q1-Q6), derived from a profile and a header: no table scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubspark.operators import stats


def quality_scores(profile_df: DataFrame, header_df: DataFrame) -> DataFrame:
    """One row: null_score, type_score, outlier_score, dup_score, overall (4 places).

    type_score is ``1 - type_issues / max(numeric columns, 1)`` and is not
    clamped: more chaotic text columns than numeric columns make it negative.
    """
    p = profile_df
    agg = p.agg(
        (F.lit(1.0) - F.avg("null_rate")).alias("null_raw"),
        F.count(F.when(F.array_contains("flags", "type_chaos"), 1)).alias("type_issues"),
        F.count(F.when(F.col("is_numeric"), 1)).alias("numeric_cols"),
        F.avg(F.when(F.col("is_numeric") & (F.col("n_values") >= 4), F.col("outlier_frac"))).alias("mean_frac"),
    )
    j = stats.side_by_side(agg, header_df.select("duplicate_rate"))
    null_s = F.col("null_raw")
    type_s = F.lit(1.0) - F.col("type_issues") / F.greatest(F.col("numeric_cols"), F.lit(1))
    out_s = F.coalesce(F.lit(1.0) - F.col("mean_frac"), F.lit(1.0))
    dup_s = F.lit(1.0) - F.col("duplicate_rate")
    return j.select(
        F.round(null_s, 4).alias("null_score"),
        F.round(type_s, 4).alias("type_score"),
        F.round(out_s, 4).alias("outlier_score"),
        F.round(dup_s, 4).alias("dup_score"),
        F.round((null_s + type_s + out_s + dup_s) / 4.0, 4).alias("overall"),
    )


def quality_band(c: Column | str) -> Column:
    """Q6: good >= 0.85, warn >= 0.6, else bad."""
    x = F.col(c) if isinstance(c, str) else c
    return F.when(x >= 0.85, "good").when(x >= 0.6, "warn").otherwise("bad")
