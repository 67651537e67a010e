"""Action replies as text (P1-P5): parse, clamp, validate.

All column expressions: no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubspark.plans.actions import ACTION_TYPES, DEFAULT_CONFIDENCE

# P5: ``reasoning`` is not in the schema, so it is dropped at parse time.
REPLY_SCHEMA = T.StructType([
    T.StructField("action_type", T.StringType()),
    T.StructField("column", T.StringType()),
    T.StructField("params", T.MapType(T.StringType(), T.StringType())),
    T.StructField("confidence", T.DoubleType()),
])


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def with_json_text(df: DataFrame, raw_col: str, out_col: str) -> DataFrame:
    """P1 text part: trim; inside a code fence take the first fenced part and
    drop a leading ``json`` tag; then the span from the first '{' to the last '}'.

    One column a step: Spark keeps a costly column that is used more than once
    in a projection of its own, so no pattern is run twice on a reply.
    """
    c = F.col(out_col)
    df = df.withColumn(out_col, _strip(F.col(raw_col)))
    fenced = f"{out_col}_fenced"
    df = df.withColumn(fenced, F.when(c.startswith("```"), F.element_at(F.split(c, "```"), 2)))
    f = F.col(fenced)
    f = F.when(F.lower(f).startswith("json"), F.substring(f, 5, 1 << 30)).otherwise(f)
    df = df.withColumn(out_col, F.when(c.startswith("```"), _strip(f)).otherwise(c)).drop(fenced)
    span = f"{out_col}_span"
    df = df.withColumn(span, F.regexp_extract(c, r"(?s)(\{.*\})", 1))
    return df.withColumn(out_col, F.when(F.col(span) != "", F.col(span)).otherwise(c)).drop(span)


def parse_actions(df: DataFrame, raw_col: str, out_col: str = "action") -> DataFrame:
    """Add ``out_col`` (struct of REPLY_SCHEMA) and ``parsed`` (bool).

    Each reply is read as JSON once: all fields come from one parsed column.
    """
    # Read as text, so a confidence in quotes counts as well.
    schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name == "confidence" else f
                           for f in REPLY_SCHEMA.fields])
    reply = f"__{out_col}_reply"
    df = with_json_text(df, raw_col, reply)
    df = df.withColumn(reply, F.from_json(reply, schema))
    number = F.trim(F.col(reply)["confidence"]).try_cast("double")
    return (df.withColumn(out_col, F.col(reply).withField("confidence", number)).drop(reply)
            .withColumn("parsed", F.col(f"{out_col}.action_type").isNotNull()))


def action_or_done(out_col: str = "action") -> Column:
    """P1 fallback: the parsed action, or ``done`` at the default confidence where the reply was no action."""
    a = F.col(out_col)
    return F.when(a["action_type"].isNotNull(), a).otherwise(F.struct(
        F.lit("done").alias("action_type"), F.lit(None).cast("string").alias("column"),
        F.create_map().cast("map<string,string>").alias("params"),
        F.lit(DEFAULT_CONFIDENCE).alias("confidence")))


def clamp_confidence(c: Column | str) -> Column:
    """Confidence into [0, 1], 0.5 when missing."""
    x = F.col(c) if isinstance(c, str) else c
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x.cast("double"), F.lit(DEFAULT_CONFIDENCE))))


def validate_actions(df: DataFrame, type_col: str = "action_type", column_col: str = "column",
                     conf_col: str = "confidence") -> DataFrame:
    """``valid`` and ``reason`` columns; the column name is trimmed."""
    conf = F.coalesce(F.col(conf_col).cast("double"), F.lit(DEFAULT_CONFIDENCE))
    reason = (F.when(~F.coalesce(F.col(type_col).isin(*ACTION_TYPES), F.lit(False)),
                     F.lit("unknown action_type"))
              .when((conf < 0) | (conf > 1), F.lit("confidence out of range")))
    return (df.withColumn(column_col, _strip(F.col(column_col)))
            .withColumn(conf_col, conf)
            .withColumn("reason", reason)
            .withColumn("valid", F.col("reason").isNull()))
