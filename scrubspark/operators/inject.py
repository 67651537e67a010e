"""Reproducible dirty-data injection.

Each draw comes from ``functions.draws.uniform`` keyed on a row key, so the
same damage lands on the same rows on any cluster layout and after any task
retry.  All operators are projections or filters except ``sample_n``
(a top-k, or an exact rank cut for large samples) and ``shuffle_rows``
(a rank the caller asks for).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from scrubspark.functions.draws import pick, uniform
from scrubspark.operators import dedup, fill, stats


def _replace(df: DataFrame, col: str, expr: Column) -> DataFrame:
    return df.withColumn(col, expr)


def inject_nulls(df: DataFrame, col: str, rate: float, key: str, salt: str, seed: int = 42) -> DataFrame:
    """Set ``col`` to NULL where the draw is below ``rate``."""
    c = F.col(col)
    return _replace(df, col, F.when(uniform(key, salt, seed) < rate, F.lit(None).cast(df.schema[col].dataType))
                    .otherwise(c))


def inject_outliers(df: DataFrame, col: str, rate: float, choices: list, key: str,
                    salt: str, pick_salt: str, seed: int = 42, keep_nulls: bool = True) -> DataFrame:
    """Replace a ``rate`` share of values with one of ``choices``."""
    c = F.col(col)
    dt = df.schema[col].dataType
    hit = uniform(key, salt, seed) < rate
    if keep_nulls:
        hit = hit & c.isNotNull()
    return _replace(df, col, F.when(hit, pick(key, pick_salt, choices, seed).cast(dt)).otherwise(c))


def inject_tokens(df: DataFrame, col: str, rate: float, tokens: list[str], key: str,
                  salt: str, pick_salt: str, seed: int = 42) -> DataFrame:
    """D3: turn a column into text and put junk tokens in a ``rate`` share of rows."""
    c = F.col(col).cast("string")
    return _replace(df, col, F.when(uniform(key, salt, seed) < rate, pick(key, pick_salt, tokens, seed))
                    .otherwise(c))


def as_text(df: DataFrame, col: str, null_text: str | None = "N/A") -> DataFrame:
    """Store a numeric column as text; whole doubles lose their ``.0``."""
    c = F.col(col)
    dt = df.schema[col].dataType.simpleString()
    if dt in ("double", "float"):
        txt = F.when(c == F.floor(c), F.floor(c).cast("bigint").cast("string")).otherwise(c.cast("string"))
    else:
        txt = c.cast("string")
    if null_text is not None:
        txt = F.coalesce(txt, F.lit(null_text))
    return _replace(df, col, txt)


def inject_duplicates(df: DataFrame, rate: float, key: str, salt: str = "dup", seed: int = 42) -> DataFrame:
    """Append a copy of each row whose draw is below ``rate`` (UNION ALL, no shuffle)."""
    return df.unionByName(df.where(uniform(key, salt, seed) < rate))


# Largest ``n`` served by a top-k: every task keeps at most this many rows and
# one task merges (tasks x n) of them.  Larger samples use an exact threshold.
TOPK_LIMIT = 100_000
# Largest merge (input partitions x n rows) a top-k may send to one task.
TOPK_MERGE_ROWS = 2_000_000

_UNITS = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def _bytes(text: str) -> int:
    t = text.strip().lower().rstrip("b") or "0"
    return int(float(t[:-1]) * _UNITS[t[-1]]) if t[-1] in _UNITS else int(t)


def _scan_partitions(df: DataFrame) -> int:
    """Input partitions the plan's size estimate implies (no job is run)."""
    try:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except AttributeError:  # a Spark Connect frame: assume it is wide (exact cut)
        return TOPK_MERGE_ROWS + 1
    split = _bytes(df.sparkSession.conf.get("spark.sql.files.maxPartitionBytes", "128m"))
    return max(1, -(-size // max(split, 1)))


def sample_n(df: DataFrame, n: int, key: str, salt: str = "sample", seed: int = 42,
             topk_limit: int = TOPK_LIMIT) -> DataFrame:
    """Exactly ``n`` rows, the ``n`` smallest by (draw, key, row hash, row text).

    The same rows come back for any size, partitioning or path below; rows tied on all four are equal rows.

    For ``n <= topk_limit``, when the input's partitions times ``n`` stays
    under ``TOPK_MERGE_ROWS``, ``orderBy(..).limit(n)`` plans as
    TakeOrderedAndProject: each task keeps its own top ``n`` (bounded memory)
    and only those reach the merge.  Otherwise the merge (or, on collect, the
    driver) would receive partitions x n rows, so the cut is found instead: the exact draw at rank ``n - 1``
    (``stats.select_ranks``), then every row below it is kept by a filter that
    stays in the scan's partitions; only rows tied on that one draw need
    more care (``_take_ties``).
    """
    u = uniform(key, salt, seed)
    if n <= topk_limit and n * _scan_partitions(df) <= TOPK_MERGE_ROWS:
        return df.withColumn("_u", u).withColumn("_h", _row_hash(df)).withColumn("_s", _row_text(df)).orderBy(
            "_u", key, "_h", "_s").limit(n).drop("_u", "_h", "_s")
    t = df.withColumn("_u", u)
    with stats.persisted(t):
        total = t.count()
        if n >= total:
            return df
        cut = stats.select_ranks(t.select(F.col("_u").alias("v")), total, [n - 1])[n - 1]
        row = t.agg(F.count(F.when(F.col("_u") < cut, 1)).alias("lt"),
                    F.count(F.when(F.col("_u") == cut, 1)).alias("eq")).first()
        need = n - row["lt"]
        below = t.where(F.col("_u") < cut).drop("_u")
        ties = t.where(F.col("_u") == cut).drop("_u")
        if need == row["eq"]:
            return below.unionByName(ties)
        return below.unionByName(_take_ties(ties, key, need))


# To the microsecond, so that rows of one text are equal rows.
_EXACT_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _row_text(df: DataFrame) -> Column:
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), _EXACT_TIMES)


def _row_hash(df: DataFrame) -> Column:
    """52 bits of the md5 of the row's text, as a double."""
    return F.conv(F.substring(F.md5(_row_text(df)), 1, 13), 16, 10).cast("double")


def _take_ties(ties: DataFrame, key: str, need: int) -> DataFrame:
    """``need`` rows of ``ties`` (rows sharing one draw), smallest keys first.

    Distinct keys sharing one 32-bit draw are few (about rows / 2**32), so
    their counts are ranked on the driver.  The one key that is cut may hold
    any number of rows (a hot key): those are cut again by an exact rank on a
    hash of the whole row.  Rows on the last hash are counted by their text: one
    row and its copies, or, where hashes of unlike rows collide, the few there
    are.  Copies are made by ``range`` across the cluster.
    """
    spark = ties.sparkSession
    k = F.col(key)
    per_key = ties.groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("c")).orderBy("k").collect()
    full, acc = [], 0
    for r in per_key:
        if acc + r["c"] > need:
            break
        full.append(r["k"])
        acc += r["c"]
    out = ties.where(F.lit(False))
    if full:
        has_null = any(x is None for x in full)
        cond = k.isin([x for x in full if x is not None])
        out = out.unionByName(ties.where(cond | k.isNull() if has_null else cond))
    rest = need - acc
    if rest == 0:
        return out
    boundary = per_key[len(full)]
    g = ties.where(k.eqNullSafe(F.lit(boundary["k"])))
    g = g.withColumn("_h", _row_hash(ties))
    with stats.persisted(g):
        hcut = stats.select_ranks(g.select(F.col("_h").alias("v")), boundary["c"], [rest - 1])[rest - 1]
        lower = g.where(F.col("_h") < hcut)
        copies = rest - lower.count()
        alike = g.where(F.col("_h") == hcut).groupBy(_row_text(ties).alias("text")).agg(
            F.count(F.lit(1)).alias("c"), F.first(F.struct(*[F.col(f"`{c}`") for c in ties.columns])).alias("row"))
        kinds = alike.orderBy("text").collect()
    out = out.unionByName(lower.drop("_h"))
    nested = (T.StructType, T.ArrayType, T.MapType)
    for kind in kinds:
        if not copies:
            break
        lits = []
        for f in ties.schema.fields:
            if isinstance(f.dataType, nested):
                # A nested value cannot be a Python literal: rebuild it from its text.
                parsed = F.from_json(F.lit(kind["text"]), T.StructType([f]), _EXACT_TIMES)
                lits.append(parsed[f.name].alias(f.name))
            else:
                lits.append(F.lit(kind["row"][f.name]).cast(f.dataType).alias(f.name))
        take = min(copies, kind["c"])
        out, copies = out.unionByName(spark.range(take).select(*lits)), copies - take
    return out


# Rows one ranking task of ``shuffle_rows`` is meant to hold.
ROWS_PER_BUCKET = 1_000_000
# Resolution of the draw histogram: 2**20 cells (draws are multiples of 2**-32).
HIST_BITS = 20
# Largest offset table that is broadcast rather than joined.
BROADCAST_OFFSETS = 100_000


def shuffle_rows(df: DataFrame, key: str, salt: str = "shuffle", seed: int = 42,
                 rank_col: str = "row_rank", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """A reproducible random row order, made visible as a 0-based rank by draw, then key, then 128 bits
    of a hash of the row, so the ranks follow from the rows alone, however they are partitioned.

    One pass builds a histogram of the draw (2**20 cells, combined map-side).
    It gives the row count, hence a power-of-two number of buckets of about
    ``rows_per_bucket`` rows each (``floor(u * buckets)``, a union of whole
    cells), and each bucket's offset: the rows in lower buckets.  A row's
    rank is its bucket's offset plus its position inside the bucket (a window
    per bucket).  A key repeated on very many rows shares one draw and would
    overload its bucket.  Where the histogram has a cell of more than two
    buckets' worth of rows, buckets are instead ranges of the whole order,
    sampled and written once (``fill.order_ranges``), which cut a hot key by
    its rows' hashes and equal rows anywhere.
    """
    # ``xxhash64`` takes no maps; their text is hashed.
    tie = [F.md5(_row_text(df))] if "map<" in df.schema.simpleString() else dedup.fingerprint(df.columns)
    t = df.withColumn("_u", uniform(key, salt, seed))
    for i, c in enumerate(tie):
        t = t.withColumn(f"_t{i}", c)
    order = ["_u", key, *[f"_t{i}" for i in range(len(tie))]]
    with stats.persisted(t):
        cells = (t.groupBy(F.floor(F.col("_u") * (1 << HIST_BITS)).cast("long").alias("_f"))
                 .agg(F.count(F.lit(1)).alias("_n")))
        with stats.persisted(cells):
            row = cells.agg(F.sum("_n").alias("n"), F.max("_n").alias("most")).first()
            n = row["n"] or 0
            if n and row["most"] >= 2 * rows_per_bucket:
                n_buckets = math.ceil(n / rows_per_bucket)
                t = fill.order_ranges(t, [F.col(c) for c in order], n_buckets).withColumnRenamed("__b", "_b")
                counts = t.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
            else:
                bits = min(HIST_BITS, max(0, math.ceil(math.log2(max(1, n / rows_per_bucket)))))
                n_buckets = 1 << bits
                t = t.withColumn("_b", F.floor(F.col("_u") * n_buckets).cast("long"))
                counts = cells.groupBy(F.shiftright("_f", HIST_BITS - bits).alias("_b")).agg(
                    F.sum("_n").alias("_n"))
            # One row per bucket: small enough to rank in one task.
            offsets = counts.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_off"))
            if n_buckets <= BROADCAST_OFFSETS:
                offsets = F.broadcast(offsets)
            ranked = t.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(*order)) - 1)
            return (ranked.join(offsets, "_b")
                    .withColumn(rank_col, (F.col("_off") + F.col("_r")).cast("bigint"))
                    .select(*[F.col(f"`{c}`") for c in df.columns], rank_col))


def synth(keys: DataFrame, key: str, colspecs: dict[str, tuple], seed: int = 42) -> DataFrame:
    """Synthetic columns over the rows of ``keys`` (one output row per key).

    ``colspecs`` maps a column name to one of:
      ("int", lo, hi)                 uniform integer in [lo, hi)
      ("normal", mean, sd)            Box-Muller on two draws
      ("lognormal", mean, sigma)      exp of a normal
      ("choice", [values], [weights]) weighted category by cumulative CASE
      ("format", pattern)             format_string(pattern, key)
      ("timeseq", start, seconds)     start + key * seconds (timestamp_ntz)
    """
    out = keys.select(F.col(key))
    k = F.col(key)
    for name, spec in colspecs.items():
        kind = spec[0]
        if kind == "int":
            lo, hi = spec[1], spec[2]
            expr = (F.lit(lo) + F.floor(uniform(k, name, seed) * (hi - lo))).cast("bigint")
        elif kind == "normal":
            u1 = F.greatest(uniform(k, name + ":a", seed), F.lit(1.0 / 4294967296.0))
            u2 = uniform(k, name + ":b", seed)
            z = F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * 3.141592653589793 * u2)
            expr = F.lit(float(spec[1])) + F.lit(float(spec[2])) * z
        elif kind == "lognormal":
            u1 = F.greatest(uniform(k, name + ":a", seed), F.lit(1.0 / 4294967296.0))
            u2 = uniform(k, name + ":b", seed)
            z = F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * 3.141592653589793 * u2)
            expr = F.exp(F.lit(float(spec[1])) + F.lit(float(spec[2])) * z)
        elif kind == "choice":
            values, weights = spec[1], spec[2]
            total = float(sum(weights))
            u = uniform(k, name, seed)
            expr, acc = None, 0.0
            for v, w in zip(values[:-1], weights[:-1]):
                acc += w / total
                expr = F.when(u < acc, F.lit(v)) if expr is None else expr.when(u < acc, F.lit(v))
            expr = F.lit(values[-1]) if expr is None else expr.otherwise(F.lit(values[-1]))
        elif kind == "format":
            expr = F.format_string(spec[1], k)
        elif kind == "timeseq":
            start, seconds = spec[1], int(spec[2])
            expr = F.timestamp_add("SECOND", k * F.lit(seconds), F.lit(start).cast("timestamp_ntz"))
        else:
            raise ValueError(f"unknown column spec {spec!r}")
        out = out.withColumn(name, expr)
    return out
