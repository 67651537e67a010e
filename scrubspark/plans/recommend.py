"""Recommend the next action from a profile (L2) in the fixed order of L4.

Order: de-duplicate when the duplicate rate is above 0.005; convert the
first ``type_chaos`` column to float64; fill the column with the most nulls
(rate above 0.01; median when it has a mean, else mode); clip the first
``heavy_outliers`` column by IQR; otherwise done.  All candidates are
returned ranked, so the head row is the recommendation and the rest is the
remaining plan in order.  The input is the profile table (one row per
column), so ranking it in one task is bounded by the number of columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scrubspark.plans.actions import Action

# The confidence attached to each recommendation.
CONF_DEDUP = 0.95
CONF_DTYPE = 0.85
CONF_FILL = 0.80
CONF_CLIP = 0.80
CONF_DONE = 0.70
DUP_TRIGGER = 0.005
NULL_TRIGGER = 0.01


def recommend(profile_df: DataFrame, header_df: DataFrame) -> DataFrame:
    """Ranked candidate actions: rank, action_type, column, params, confidence."""
    p = profile_df
    empty_map = F.create_map().cast("map<string,string>")
    dedup_c = header_df.where(F.col("duplicate_rate") > DUP_TRIGGER).select(
        F.lit(1).alias("prio"), F.lit(0.0).alias("k1"), F.lit(0).alias("k2"),
        F.lit("remove_duplicates").alias("action_type"), F.lit(None).cast("string").alias("column"),
        empty_map.alias("params"), F.lit(CONF_DEDUP).alias("confidence"))
    dtype_c = p.where(F.array_contains("flags", "type_chaos")).select(
        F.lit(2).alias("prio"), F.lit(0.0).alias("k1"), F.col("ordinal").alias("k2"),
        F.lit("fix_dtype").alias("action_type"), F.col("name").alias("column"),
        F.create_map(F.lit("target_dtype"), F.lit("float64")).alias("params"),
        F.lit(CONF_DTYPE).alias("confidence"))
    fill_c = p.where(F.col("null_rate") > NULL_TRIGGER).select(
        F.lit(3).alias("prio"), (-F.col("null_rate")).alias("k1"), F.col("ordinal").alias("k2"),
        F.lit("fill_nulls").alias("action_type"), F.col("name").alias("column"),
        F.create_map(F.lit("strategy"), F.when(F.col("mean").isNotNull(), F.lit("median"))
                     .otherwise(F.lit("mode"))).alias("params"),
        F.lit(CONF_FILL).alias("confidence"))
    clip_c = p.where(F.array_contains("flags", "heavy_outliers")).select(
        F.lit(4).alias("prio"), F.lit(0.0).alias("k1"), F.col("ordinal").alias("k2"),
        F.lit("clip_outliers").alias("action_type"), F.col("name").alias("column"),
        F.create_map(F.lit("method"), F.lit("iqr")).alias("params"), F.lit(CONF_CLIP).alias("confidence"))
    done_c = header_df.select(
        F.lit(5).alias("prio"), F.lit(0.0).alias("k1"), F.lit(0).alias("k2"),
        F.lit("done").alias("action_type"), F.lit(None).cast("string").alias("column"),
        empty_map.alias("params"), F.lit(CONF_DONE).alias("confidence"))
    cands = dedup_c.unionByName(dtype_c).unionByName(fill_c).unionByName(clip_c).unionByName(done_c)
    # One row per (action, column) candidate: bounded by the width of the table.
    w = Window.orderBy("prio", "k1", "k2")
    return cands.select(F.row_number().over(w).alias("rank"), "action_type", "column", "params",
                        "confidence")


def next_action(prof: list[dict], header: dict, skip: set | None = None) -> Action:
    """The best candidate from a profile and header that are already on the driver: ``recommend`` without a job."""
    found = [(1, 0.0, 0, "remove_duplicates", None, {}, CONF_DEDUP)] if header["duplicate_rate"] > DUP_TRIGGER else []
    for d in prof:
        if "type_chaos" in d["flags"]:
            found.append((2, 0.0, d["ordinal"], "fix_dtype", d["name"], {"target_dtype": "float64"}, CONF_DTYPE))
        if d["null_rate"] > NULL_TRIGGER:
            how = "mode" if d["mean"] is None else "median"
            found.append((3, -d["null_rate"], d["ordinal"], "fill_nulls", d["name"], {"strategy": how}, CONF_FILL))
        if "heavy_outliers" in d["flags"]:
            found.append((4, 0.0, d["ordinal"], "clip_outliers", d["name"], {"method": "iqr"}, CONF_CLIP))
    for *_, kind, column, params, confidence in sorted(found, key=lambda f: f[:3]):
        if (kind, column) not in (skip or ()):
            return Action(kind, column, params, confidence)
    return Action("done", confidence=CONF_DONE)


def top_action(ranked: DataFrame, skip: set | None = None) -> Action:
    """The best candidate not in ``skip`` ((action_type, column) pairs)."""
    skip = skip or set()
    for r in ranked.orderBy("rank").collect():
        if (r["action_type"], r["column"]) in skip and r["action_type"] != "done":
            continue
        return Action(r["action_type"], r["column"], dict(r["params"] or {}), r["confidence"])
    return Action("done", confidence=CONF_DONE)
