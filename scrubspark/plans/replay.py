"""Replay verification (V1-V3).

The digest is order-insensitive and computed in parallel: every row is
rendered to text (each field as its length, a colon and its text; NULL as
``~``, which no length begins with), hashed with md5, and the first 60 bits of
the hashes are summed as a DECIMAL(38,0) together with the row count.  A sum,
not XOR: equal rows would cancel under XOR.

Doubles are rendered in full, so tables that differ in one last bit have
different digests; fits are bit-equal between runs (``exact_sums``), so a
replay still verifies.  The text is made by exact arithmetic only, which any
engine repeats: a power of two brings the value between 2^-32 and 2^32
(``SCALES``), and its whole part and two times 42 bits below it are written as
integers.  -0.0 is 0.0; NaN and infinities are written by name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubspark.functions.refusals import Refusal
from scrubspark.operators import stats
from scrubspark.plans.actions import Action
from scrubspark.plans.clean import clean


#: (exponent, least magnitude, half scale): a value of at least that magnitude is multiplied twice by the half scale.
SCALES = [(64 * j, math.ldexp(1.0, 64 * j - 32) if 64 * j - 32 >= -1074 else 0.0, math.ldexp(1.0, -32 * j))
          for j in range(16, -18, -1)]
BITS = math.ldexp(1.0, 42)


def _is_double(t: T.DataType) -> bool:
    return isinstance(t, (T.DoubleType, T.FloatType))


def _with_length(c: Column, text: Column) -> Column:
    return F.when(c.isNull(), F.lit("~")).otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text))


def rendered(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """The rows of ``cols`` as text columns f0, f1, ...; equal texts mean equal cells.

    Three projections, so that the parts of a double are computed once each and all stay in generated code.
    """
    fields = [df.schema[c] for c in (cols or df.columns)]
    first, second, last = [], [], []
    for i, f in enumerate(fields):
        c, x, v = F.col("`" + f.name.replace("`", "``") + "`"), F.col(f"x{i}"), F.col(f"v{i}")
        if not _is_double(f.dataType):
            first.append(_with_length(c, c.cast("string")).alias(f"f{i}"))
            second.append(f"f{i}")
            last.append(f"f{i}")
            continue
        d = c.cast("double") + F.lit(0.0)
        plain = (F.abs(d) >= SCALES[16][1]) & (F.abs(d) < SCALES[15][1]) | (d == 0.0)
        half = F.when(plain, F.lit(1.0))
        for _, least, scale in SCALES:
            half = half.when(F.abs(d) >= least, F.lit(scale))
        known = ~F.isnan(d) & (F.abs(d) < math.inf)
        first += [d.alias(f"v{i}"), F.when(known, half).alias(f"x{i}")]
        scaled = v * x * x
        whole = scaled.cast("bigint")
        second += [v, x, whole.alias(f"w{i}"), ((scaled - whole) * BITS).alias(f"y{i}")]
        y = F.col(f"y{i}")
        exponent = (F.round(F.log2(x)) * -2).cast("int").cast("string")
        upper = y.cast("bigint")
        text = F.when(x.isNotNull(), F.concat_ws(":", exponent, F.col(f"w{i}"), upper, ((y - upper) * BITS).cast("bigint"))) \
            .when(F.isnan(v), "nan").when(v > 0, "inf").otherwise("-inf")
        last.append(_with_length(v, text).alias(f"f{i}"))
    return df.select(*first).select(*second).select(*last)


def digest(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """V2: one row (n_rows, digest) that ignores row order and partitioning."""
    texts = rendered(df, cols)
    h = F.md5(F.concat_ws("", *[F.col(c) for c in texts.columns]))
    part = F.conv(F.substring(h, 1, 15), 16, 10).cast("decimal(38,0)")
    return texts.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(part).cast("string").alias("digest"))


def replay(raw: DataFrame, log_df: DataFrame, spec=None, order_by=None, exact: bool = True) -> DataFrame:
    """V1: re-apply the successful logged actions that changed something, in step order, to ``raw``.

    The log is small (one row per action) and is read on the driver; the
    table work is the same lazy plan as the original run.
    """
    rows = log_df.where(F.col("success") & ~F.col("noop")).orderBy("step").collect()
    actions = [Action.from_row(r) for r in rows]
    out, replay_log = clean(raw, actions, spec, order_by, exact)
    if any(not r["success"] for r in replay_log.collect()):
        raise Refusal("replay_failed", detail="an action that succeeded before is refused now")
    return out


def verify(raw: DataFrame, log_df: DataFrame, current: DataFrame, spec=None, order_by=None,
           exact: bool = True) -> DataFrame:
    """V3: one row (replay_ok, n_rows, digest, replay_digest).  An empty log is not reproducible."""
    cur = digest(current)
    if log_df.limit(1).count() == 0:
        return cur.select(F.lit(False).alias("replay_ok"), "n_rows", "digest",
                          F.lit(None).cast("string").alias("replay_digest"))
    try:
        rep = digest(replay(raw, log_df, spec, order_by, exact)).select(
            F.col("n_rows").alias("r_rows"), F.col("digest").alias("replay_digest"))
    except Refusal:  # an action's own; faults of the cluster propagate
        return cur.select(F.lit(False).alias("replay_ok"), "n_rows", "digest",
                          F.lit(None).cast("string").alias("replay_digest"))
    j = stats.side_by_side(cur, rep)
    same = (F.col("n_rows") == F.col("r_rows")) & (F.col("digest") == F.col("replay_digest"))
    return j.select(same.alias("replay_ok"), "n_rows", "digest", "replay_digest")
