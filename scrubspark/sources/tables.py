"""Sources and sinks: provided parquet tables, CSV uploads, JSON score records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubspark.sources import csv_records

# The tokens a CSV reader in the pandas tradition treats as
# missing by default (pandas ``read_csv`` documentation, ``na_values``).
DEFAULT_NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


SPREAD_MIN_BYTES, SPREAD_MAX_BYTES = 1 << 20, 1 << 30
DEAL_BYTES = 8 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str, spread: bool = True) -> DataFrame:
    """One provided table.  Parquet keeps column pruning and filter push-down.

    A file written as one row group is one split, so every later stage would
    run in one task.  With ``spread`` such a scan (fewer splits than the
    session's parallelism, 1 MB to 1 GB) is spread round-robin over the
    cores; a large table already has enough splits and is left alone.
    """
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread_small_scan(df) if spread else df


def spread_small_scan(df: DataFrame) -> DataFrame:
    try:
        par = df.sparkSession.sparkContext.defaultParallelism
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        parts = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - a Spark Connect frame: leave the scan as it is
        return df
    if SPREAD_MIN_BYTES <= size <= SPREAD_MAX_BYTES and parts < par:
        return df.repartition(par)
    return df


def deal_rows(df: DataFrame) -> DataFrame:
    """The rows of a scan dealt round-robin, for work that costs far more per row than reading it.

    A Parquet row group is read whole by one split, so the number of splits
    does not tell how many hold rows, and one of them may hold all.  Here the
    tasks grow with the table: one for ``DEAL_BYTES`` of it, at least one a core.
    """
    try:
        par = df.sparkSession.sparkContext.defaultParallelism
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # noqa: BLE001 - a Spark Connect frame: adaptive execution sizes the parts
        return df.hint("rebalance")
    return df if size < SPREAD_MIN_BYTES else df.repartition(max(par, -(-size // DEAL_BYTES)))


def normalize(df: DataFrame) -> DataFrame:
    """Make NaN a NULL in every float column.

    pandas treats NaN and None alike; Spark does not (avg/max over NaN give
    NaN, percentiles sort NaN last).  This is a projection only.
    """
    if not any(isinstance(f.dataType, (T.DoubleType, T.FloatType)) for f in df.schema.fields):
        return df
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.col(f"`{f.name}`")
            cols.append(F.when(F.isnan(c), F.lit(None).cast(f.dataType)).otherwise(c).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def null_tokens(df: DataFrame, tokens=DEFAULT_NA_TOKENS, columns: list[str] | None = None) -> DataFrame:
    """Turn missing-value tokens in text columns into NULL."""
    toks = list(tokens)
    names = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in names:
            out.append(F.when(c.isin(toks), F.lit(None).cast("string")).otherwise(c).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def read_csv(spark: SparkSession, path: str, na_tokens=DEFAULT_NA_TOKENS,
             infer_schema: bool = True) -> DataFrame:
    """CSV upload (S1): header row, quoted line breaks, tokens to NULL, then types inferred.

    A file of any size is read by as many tasks as it has splits (``csv_records``).

    Spark's CSV reader keeps ``N/A`` as text, which would make a numeric
    column a text column; tokens are nulled first and the types are then
    inferred on the cleaned text, all columns in one aggregate.  A column is
    bigint if every value is a whole number of that range, double if every
    value is a number or an infinity (whole numbers past bigint stay text:
    a double would not keep their digits), boolean if every value is
    ``True`` or ``False`` in any case, and text otherwise.
    """
    cleaned = null_tokens(csv_records.read_text_columns(spark, path), na_tokens)
    if not infer_schema:
        return cleaned
    from scrubspark.functions.numeric import parse_number
    whole = r"^\s*[+-]?[0-9]+\s*$"
    rules = {}
    for c in cleaned.columns:
        col = F.col(f"`{c}`")
        text = F.trim(col)
        rules[c] = (("bigint", text.try_cast("bigint"), col.rlike(whole) & text.try_cast("bigint").isNotNull()),
                    ("double", parse_number(col), parse_number(col).isNotNull() & (
                        ~col.rlike(whole) | text.try_cast("bigint").isNotNull())),
                    ("boolean", F.lower(text) == "true", F.lower(text).isin("true", "false")))
    # A column without any value stays text.
    checks = [F.coalesce(F.bool_and(F.when(F.col(f"`{c}`").isNotNull(), fits)), F.lit(False)).alias(f"{kind}{i}")
              for i, c in enumerate(cleaned.columns) for kind, _, fits in rules[c]]
    row = cleaned.agg(*checks).first()
    out = []
    for i, c in enumerate(cleaned.columns):
        col = F.col(f"`{c}`")
        made = next((value for kind, value, _ in rules[c] if row[f"{kind}{i}"]), col)
        out.append(made.alias(c))
    return cleaned.select(*out)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON records sink (S4), one file per partition."""
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV sink, read back whole by ``read_csv``: quotes doubled, blanks kept."""
    (df.write.mode(mode).option("header", True).option("escape", '"').option("quoteAll", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
