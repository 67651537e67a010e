"""The query catalogue: one Spark job per operator, on the provided tables.

Each function takes ``(spark, sf_dir)`` and returns a DataFrame.  Computed
columns carry the same names as in ``catalog.oracle``.  Doubles that come out
of a fitted statistic are rounded to 4 places on both sides, because two
engines may sum in a different order and differ in the last bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubspark.catalog import fixtures as fx
from scrubspark.operators import clip, columns, dedup, dtype, fill, inject, stats
from scrubspark.functions.draws import uniform
from scrubspark.sources.tables import read_table

QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _r4(c: str):
    return F.round(F.col(c), 4).alias(c)


def _r6(c: str):
    """Quantile-derived values (interpolated quartiles, IQR fences) of 2-decimal data
    have at most 5 decimals: rounding them to 4 would hit exact ties, which engines
    break differently, so they are compared at 6."""
    return F.round(F.col(c), 6).alias(c)


# --- D1-D8: injection -------------------------------------------------------

@query
def inject_nulls(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "events").select("event_id", "value")
    return inject.inject_nulls(e, "value", 0.25, "event_id", "val_null")


@query
def inject_outliers(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "events").select("event_id", "value")
    return inject.inject_outliers(e, "value", 0.08, fx.VALUE_OUTLIERS, "event_id", "val_out", "val_pick")


@query
def inject_tokens(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 20).alias("qty_text"))
    return inject.inject_tokens(o, "qty_text", 0.18, fx.QTY_TOKENS, "o_orderkey", "qty_tok", "qty_pick")


@query
def as_text(spark: SparkSession, sf: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    li = inject.inject_nulls(li, "l_quantity", 0.10, F.concat_ws("-", "l_orderkey", "l_linenumber"), "qty_null")
    return inject.as_text(li, "l_quantity", "N/A")


@query
def inject_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return inject.inject_duplicates(o, 0.10, "o_orderkey", "dup")


@query
def sample_n(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return inject.sample_n(o, 1000, "o_orderkey", "sample")


@query
def sample_n_cut(spark: SparkSession, sf: str) -> DataFrame:
    """The same sample through the exact rank cut that large samples use."""
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return inject.sample_n(o, 1000, "o_orderkey", "sample", topk_limit=0)


@query
def shuffle_rows(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders").select("o_orderkey")
    return inject.shuffle_rows(o, "o_orderkey", "shuffle")


SYNTH_SPEC = {
    "shelf": ("int", 1, 40),
    "weight": ("normal", 12.5, 3.0),
    "value": ("lognormal", 2.0, 0.5),
    "grade": ("choice", ["a", "b", "c"], [0.7, 0.2, 0.1]),
    "label": ("format", "box %07d"),
    "packed_at": ("timeseq", "2024-03-01 06:00:00", 600),
}


@query
def synth_columns(spark: SparkSession, sf: str) -> DataFrame:
    keys = read_table(spark, sf, "orders").select("o_orderkey")
    out = inject.synth(keys, "o_orderkey", SYNTH_SPEC)
    return out.select("o_orderkey", "shelf", _r4("weight"), _r4("value"), "grade", "label", "packed_at")


# --- C1-C5: fills --------------------------------------------------------------

@query
def fill_mean(spark, sf):
    d = fx.dirty_orders(spark, sf)
    return fill.fill_nulls(d, "o_totalprice", "mean").select("o_orderkey", _r4("o_totalprice"))


@query
def fill_median(spark, sf):
    d = fx.dirty_orders(spark, sf)
    return fill.fill_nulls(d, "o_totalprice", "median").select("o_orderkey", _r4("o_totalprice"))


@query
def fill_mode_num(spark, sf):
    d = fx.dirty_orders(spark, sf)
    return fill.fill_nulls(d, "o_totalprice", "mode").select("o_orderkey", "o_totalprice")


@query
def fill_mode_text(spark, sf):
    d = fx.dirty_orders(spark, sf)
    return fill.fill_nulls(d, "o_orderpriority", "mode").select("o_orderkey", "o_orderpriority")


@query
def fill_constant(spark, sf):
    d = fx.dirty_orders(spark, sf)
    return fill.fill_nulls(d, "o_totalprice", "constant", 0).select("o_orderkey", "o_totalprice")


@query
def fill_constant_bad(spark, sf):
    """Constants that a column cannot hold are refused alone and beside other fills; what is left NULL is measured."""
    d = fx.dirty_orders(spark, sf).select("o_orderkey", "o_totalprice", F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey") % 1000)
                                          .cast("int").alias("small"))
    plans = {"both_bad": [("o_totalprice", "abc"), ("small", 30000000000)], "one_bad": [("o_totalprice", "1.5"), ("small", "x")],
             "alone_bad": [("small", "30000000000")], "alone_good": [("small", "7")], "both_good": [("o_totalprice", 2), ("small", 7)]}
    out = None
    for name, fills in plans.items():
        done, log = clean(d, [Action("fill_nulls", c, {"strategy": "constant", "value": v}) for c, v in fills])
        left = done.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in ("o_totalprice", "small")]).first()
        rows = log.select(F.lit(name).alias("plan"), "step", F.col("column").alias("col"), "success", F.round("null_after", 6).alias("null_after"),
                          F.when(F.col("column") == "small", F.lit(left["small"])).otherwise(F.lit(left["o_totalprice"])).alias("left_null"))
        rows = rows.withColumn("left_null", F.round("left_null", 6))
        out = rows if out is None else out.unionByName(rows)
    return out


@query
def fill_ffill(spark, sf):
    e = fx.dirty_events(spark, sf)
    out = fill.fill_nulls(e, "value", "ffill", order_by=["ts", "event_id"],
                          bucket=F.date_trunc("day", F.col("ts")))
    return out.select("event_id", "value")


@query
def fill_ffill_balanced(spark, sf):
    e = fx.dirty_events(spark, sf)
    out = fill.forward_fill(e, "value", ["ts", "event_id"], bucket="auto", n_buckets=16)
    return out.select("event_id", "value")


# --- C6-C7: duplicates ---------------------------------------------------------

@query
def dedup_all(spark, sf):
    return dedup.remove_duplicates(fx.dirty_orders(spark, sf))


@query
def dedup_subset(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text", "lang", "n_chars")
    return dedup.remove_duplicates(docs, subset=["text"], order_by=["doc_id"]).drop("text")


# --- C8-C12: types -------------------------------------------------------------

@query
def dtype_int(spark, sf):
    d = fx.dirty_orders(spark, sf)
    return dtype.fix_dtype(d, "qty_text", "int64").select("o_orderkey", "qty_text")


@query
def dtype_int_check(spark, sf):
    d = fx.dirty_orders(spark, sf)
    n = dtype.fractional_count(d, "o_totalprice")
    ok = n == 0
    return spark.range(1).select(F.lit("o_totalprice").alias("column"),
                                 F.lit(n).cast("bigint").alias("n_fractional"),
                                 F.lit(ok).alias("castable"))


@query
def dtype_float(spark, sf):
    d = fx.dirty_orders(spark, sf)
    return dtype.fix_dtype(d, "qty_text", "float64").select("o_orderkey", "qty_text")


@query
def dtype_str(spark, sf):
    d = fx.dirty_orders(spark, sf)
    return dtype.fix_dtype(d, "o_custkey", "str", null_text="nan").select("o_orderkey", "o_custkey")


@query
def dtype_timestamp(spark, sf):
    e = fx.dirty_events(spark, sf)
    return dtype.fix_dtype(e, "ts_text", "datetime64").select("event_id", "ts_text")


@query
def dtype_bool(spark, sf):
    e = fx.dirty_events(spark, sf)
    return dtype.fix_dtype(e, "flag_text", "bool").select("event_id", "flag_text")


# --- C13-C17: clipping, renaming, dropping ------------------------------------------

@query
def clip_iqr(spark, sf):
    e = read_table(spark, sf, "events").select("event_id", "value")
    return clip.clip_outliers(e, "value", "iqr").select("event_id", _r6("value"))


@query
def clip_zscore(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "n_chars")
    return clip.clip_outliers(d, "n_chars", "zscore", threshold=3.0).select("doc_id", _r4("n_chars"))


@query
def clip_percentile(spark, sf):
    d = fx.dirty_orders(spark, sf)
    return clip.clip_outliers(d, "o_totalprice", "percentile", lower_pct=1, upper_pct=99) \
        .select("o_orderkey", _r6("o_totalprice"))


@query
def rename_drop(spark, sf):
    d = fx.dirty_orders(spark, sf)
    d = columns.rename_column(d, "o_orderpriority", "priority")
    return columns.drop_column(d, "admin_note")


# --- F1-F14: profiling ---------------------------------------------------------

from scrubspark.catalog import specs  # noqa: E402
from scrubspark.operators import grade as grading  # noqa: E402
from scrubspark.operators import profile as profiling  # noqa: E402
from scrubspark.operators import profile_state  # noqa: E402
from scrubspark.operators import quality  # noqa: E402

_NUM_PROFILE = ["mean", "std", "min", "max", "q1", "q3", "outlier_frac"]


def _orders_profile(spark, sf, order_by=None):
    d = fx.dirty_orders(spark, sf)
    return d, profiling.profile(d, order_by=order_by)


@query
def profile_numeric(spark, sf):
    _, p = _orders_profile(spark, sf)
    return p.where("is_numeric").select("name", _r4("null_rate"), "n_unique", *[_r4(c) for c in _NUM_PROFILE])


@query
def profile_text(spark, sf):
    _, p = _orders_profile(spark, sf)
    return p.where("is_text").select("name", _r4("null_rate"), "n_unique", _r4("parse_rate"))


@query
def profile_flags(spark, sf):
    _, p = _orders_profile(spark, sf)
    return p.select("name", F.array_join("flags", ", ").alias("flags"))


@query
def profile_samples(spark, sf):
    d = fx.dirty_orders(spark, sf)
    s = profiling.sample_values_frame(d, ["o_orderkey"], 3)
    return s.select("name", F.array_join("sample_values", "|").alias("sample_values"))


@query
def table_header(spark, sf):
    h = profiling.table_header(fx.dirty_orders(spark, sf))
    return h.select("n_rows", "n_cols", _r4("duplicate_rate"))


@query
def profile_lines(spark, sf):
    _, p = _orders_profile(spark, sf)
    return profiling.profile_lines(p).select("name", "line")


@query
def profile_header(spark, sf):
    d = fx.dirty_orders(spark, sf)
    prof, head = profiling.fit_profile_and_header(d)
    h = profiling.header_frame(spark, head)
    return profiling.header_lines(h, quality.quality_scores(profiling.profile(d, prof=prof), h))


# --- Q1-Q6: quality ------------------------------------------------------------------

def _quality(df):
    prof, head = profiling.fit_profile_and_header(df, distinct=False)
    return quality.quality_scores(profiling.profile(df, prof=prof), profiling.header_frame(df.sparkSession, head))


@query
def quality_scores(spark, sf):
    return _quality(fx.dirty_orders(spark, sf))


@query
def quality_band(spark, sf):
    a = _quality(fx.dirty_orders(spark, sf)).select(F.lit("dirty_orders").alias("table_name"), "overall")
    b = _quality(fx.dirty_events(spark, sf)).select(F.lit("dirty_events").alias("table_name"), "overall")
    return a.unionByName(b).withColumn("band", quality.quality_band("overall"))


# --- G1-G12: grading ---------------------------------------------------------------

@query
def grade_orders(spark, sf):
    return grading.grade(fx.dirty_orders(spark, sf), specs.ORDERS_SPEC)


def graded_events(spark, sf):
    """The dirty events and a text column of which a part parses as numbers."""
    user = F.col("user_id")
    return fx.dirty_events(spark, sf).withColumn("user_text", F.when(user % 6 == 0, "N/A").otherwise(user.cast("string")))


@query
def grade_events(spark, sf):
    return grading.grade(graded_events(spark, sf), specs.EVENTS_SPEC)


@query
def grade_plain(spark, sf):
    """The weights of a spec without drop or parse checks."""
    return grading.grade(read_table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount"), specs.LINEITEM_SPEC)


@query
def grade_capped(spark, sf):
    """A weighted sum and drop bonus above 1 are cut to 1."""
    return grading.grade(read_table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity"), specs.CAPPED_SPEC).select("drop_bonus", "score", "passed")


@query
def grade_default(spark, sf):
    return grading.grade(fx.dirty_orders(spark, sf), grading.default_spec())


@query
def range_rules(spark, sf):
    return grading.range_rule_detail(fx.dirty_orders(spark, sf), specs.ORDERS_SPEC.rules)


@query
def parse_rate(spark, sf):
    return grading.parse_rate_detail(fx.dirty_orders(spark, sf))


# --- L1-L4, C18-C20, V1-V3: plans and replay ---------------------------------------

from scrubspark.plans import auto as autoplan  # noqa: E402
from scrubspark.plans import compare  # noqa: E402
from scrubspark.plans import recommend as rec  # noqa: E402
from scrubspark.plans import replay as rep  # noqa: E402
from scrubspark.plans.actions import Action  # noqa: E402
from scrubspark.plans.clean import clean  # noqa: E402

CLEAN_PLAN = [
    Action("remove_duplicates", confidence=0.95),
    Action("fix_dtype", "qty_text", {"target_dtype": "float64"}, 0.85),
    Action("fill_nulls", "o_totalprice", {"strategy": "median"}, 0.80),
    Action("clip_outliers", "o_totalprice", {"method": "iqr"}, 0.80),
    Action("drop_column", "admin_note", confidence=0.90),
    Action("rename_column", "o_orderpriority", {"new_name": "priority"}, 0.60),
    Action("done", confidence=0.70),
]

PRECHECK_PLAN = [
    Action("fill_nulls", "missing_col", {"strategy": "mean"}, 0.9),
    Action("clip_outliers", "o_orderpriority", {"method": "iqr"}, 0.9),
    Action("fix_dtype", "o_totalprice", {"target_dtype": "int64"}, 0.9),
    Action("fill_nulls", "o_totalprice", {"strategy": "bogus"}, 0.9),
    Action("fill_nulls", "o_orderkey", {"strategy": "mean"}, 0.9),
    Action("rename_column", "o_custkey", {"new_name": "o_orderkey"}, 0.9),
    Action("fix_dtype", "o_orderpriority", {"target_dtype": "str"}, 0.9),
    Action("remove_duplicates", confidence=0.9),
]


def _clean_orders(spark, sf):
    d = fx.dirty_orders(spark, sf)
    out, log = clean(d, CLEAN_PLAN, specs.ORDERS_SPEC)
    return d, out, log


@query
def clean_plan(spark, sf):
    _, out, _ = _clean_orders(spark, sf)
    return out.withColumn("o_totalprice", F.round("o_totalprice", 6))


@query
def action_metrics(spark, sf):
    _, _, log = _clean_orders(spark, sf)
    return log.select("step", "action_type", "success", "noop", "rows_before", "rows_after", "cols_after",
                      _r4("null_before"), _r4("null_after"), "dtype_before", "dtype_after", "n_outliers",
                      _r4("std_before"), _r4("std_after"), _r4("std_reduction"))


@query
def precheck(spark, sf):
    d = fx.dirty_orders(spark, sf)
    _, log = clean(d, PRECHECK_PLAN, specs.ORDERS_SPEC)
    status = F.when(~F.col("success"), "error").when(F.col("noop"), "noop").otherwise("ok")
    return log.select("step", "action_type", "column", status.alias("status"))


@query
def recommend(spark, sf):
    d = fx.dirty_orders(spark, sf)
    prof, head = profiling.fit_profile_and_header(d, distinct=False)
    ranked = rec.recommend(profiling.profile(d, prof=prof), profiling.header_frame(spark, head))
    return ranked.select("rank", "action_type", "column",
                         F.try_element_at(F.map_values("params"), F.lit(1)).alias("param"), "confidence")


@query
def auto_clean_grade(spark, sf):
    d = fx.dirty_orders(spark, sf)
    _, log, g = autoplan.auto_clean(d, specs.ORDERS_SPEC, max_steps=12)
    # The grade is one row, already on the driver: attach it as literals.
    r = g.first()
    return log.select("step", "action_type", "column", "success", "noop",
                      *[F.lit(r[c]).cast(g.schema[c].dataType).alias(c) for c in ("score", "passed", "steps")])


@query
def table_differences(spark, sf):
    """Which orders, and which of their columns, two versions of the table disagree on."""
    left = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    key = F.col("o_orderkey")
    right = left.where(key % 997 != 0).withColumns({
        "o_totalprice": F.when(key % 501 == 0, F.col("o_totalprice") + 1e-9 * F.col("o_totalprice")).otherwise(F.col("o_totalprice")),
        "o_orderstatus": F.when(key % 1503 != 0, F.col("o_orderstatus"))})
    right = right.unionByName(left.where(key % 800 == 0).withColumn("o_orderkey", -key))
    return compare.differences(left, right, "o_orderkey").withColumn("columns", F.array_join("columns", ","))


@query
def profile_appended(spark, sf):
    """The profile of a table whose files come one after another: each update reads the new files only.

    Distinct count, quartiles and outlier share are given where they are exact (at most ``profile_state.KEEP`` distinct values).
    """
    base = f"{checkpoint_dir(spark).rstrip('/')}/appended-{uuid.uuid4().hex}"
    d = fx.dirty_orders(spark, sf)
    with stats.persisted(d):
        for k in range(3):
            d.where(F.pmod(F.xxhash64("o_orderkey"), F.lit(3)) == k).write.mode("append").parquet(f"{base}/data")
            profile_state.update(spark, f"{base}/state", f"{base}/data")
    p = profile_state.frame(spark, profile_state.stored_profile(spark, f"{base}/state")[0])
    whole = F.array_contains("exact", "n_unique")
    return p.select("name", "n_rows", _r4("null_rate"), *[_r4(c) for c in ("mean", "std", "min", "max", "parse_rate")],
                    *[F.when(whole, F.round(c, 6)).alias(c) for c in ("q1", "q3", "outlier_frac")], F.when(whole, F.col("n_unique")).alias("n_unique"))


MOMENT_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query
def moments_exact(spark, sf):
    """Means and deviations that every run repeats to the last bit (fits of C1 and C14)."""
    m = stats.moments(read_table(spark, sf, "lineitem"), MOMENT_COLS)
    rows = [(c, m[c]["n"], round(m[c]["mean"], 8), round(m[c]["std"], 6)) for c in MOMENT_COLS]
    return stats.local_frame(spark, rows, "column string, n bigint, mean_value double, std_value double")


DIGEST_COLS = ["o_orderkey", "o_totalprice", "o_orderpriority", "qty_text"]


@query
def digest(spark, sf):
    return rep.digest(fx.dirty_orders(spark, sf), DIGEST_COLS)


@query
def replay_verify(spark, sf):
    raw, out, log = _clean_orders(spark, sf)
    return rep.verify(raw, log, out, specs.ORDERS_SPEC)


# --- A1-A16: action-log analytics ----------------------------------------------------

from scrubspark.operators import loglytics as la  # noqa: E402


def _scored(spark, sf):
    return la.score_log(fx.action_log(spark, sf))


@query
def log_scored(spark, sf):
    s = _scored(spark, sf)
    return s.select("run_id", "step", "action_type", F.round("action_value", 6).alias("action_value"),
                    "confidence_term", "ordering_bonus", "early_exit_penalty",
                    F.round("done_bonus", 6).alias("done_bonus"), "provenance", "reward")


@query
def log_cumulative(spark, sf):
    return _scored(spark, sf).select("run_id", "step", "reward", "cumulative", "cumulative_stored")


@query
def log_ordering(spark, sf):
    s = _scored(spark, sf)
    return s.where(F.col("ordering_bonus") > 0).select("run_id", "step", "action_type", "ordering_bonus")


@query
def log_terminal(spark, sf):
    v = la.valid_steps(fx.action_log(spark, sf))
    return v.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_valid"), F.max("terminal_step").alias("terminal_step"))


@query
def log_breakdown_top(spark, sf):
    s = _scored(spark, sf)
    bd = la.breakdown(s)
    return s.select("run_id", "step", F.array_join(F.map_keys(bd), ",").alias("components"),
                    la.dominant_component(bd).alias("dominant"))


@query
def log_last_n(spark, sf):
    return la.last_n(_scored(spark, sf), ["run_id"], "step", 15).select("run_id", "step", "reward")


@query
def log_explain(spark, sf):
    return la.explain_lines(_scored(spark, sf))


@query
def log_moving_avg(spark, sf):
    return la.moving_average(_scored(spark, sf), 3).select("run_id", "step", "moving_avg")


@query
def log_smoothed(spark, sf):
    """Values of each user's events smoothed by the width rule."""
    e = read_table(spark, sf, "events").select("user_id", "event_id", "value").where("value is not null")
    out = la.smoothed(e, ["user_id"], "event_id", "value")
    return out.select("user_id", "event_id", "width", F.round(F.col("moving_avg"), 4).alias("moving_avg"))


@query
def log_group_mean(spark, sf):
    return la.group_mean(_scored(spark, sf), ["action_type"], "reward", "mean_reward")


@query
def log_run_summary(spark, sf):
    return la.run_summary(_scored(spark, sf))


# --- P1-P5: replies as text --------------------------------------------------------------

from scrubspark.functions import replies  # noqa: E402


@query
def parse_actions(spark, sf):
    p = replies.parse_actions(fx.raw_replies(spark, sf), "raw")
    return p.select("event_id", "action.action_type", "action.column",
                    F.col("action.params")["strategy"].alias("strategy"), "action.confidence", "parsed")


@query
def parse_fallback(spark, sf):
    p = replies.parse_actions(fx.raw_replies(spark, sf), "raw")
    p = p.withColumn("action", replies.action_or_done())
    return p.select("event_id", "action.action_type", "action.column", "action.confidence", "parsed")


@query
def fill_mean_int(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return fill.fill_nulls(inject.inject_nulls(o, "o_custkey", 0.2, "o_orderkey", "int_null"), "o_custkey", "mean")


@query
def profile_nan(spark, sf):
    """Moments of a column with NaN in a tenth of its rows: NaN counts as missing."""
    e = read_table(spark, sf, "events").select("event_id", "value")
    e = e.withColumn("value", F.when(uniform("event_id", "nan") < 0.1, F.lit(float("nan"))).otherwise(F.col("value")))
    p = profiling.profile(e).where("name = 'value'")
    return p.select("name", F.round("null_rate", 6).alias("null_rate"), "n_unique", F.round("mean", 4).alias("mean"))


@query
def dtype_int_long(spark, sf):
    """Whole numbers past 2^53 as text come back digit by digit."""
    o = read_table(spark, sf, "orders").select("o_orderkey")
    o = o.withColumn("long_text", (F.lit(9007199254740993) + F.col("o_orderkey")).cast("string"))
    return dtype.fix_dtype(o, "long_text", "int64")


@query
def clamp_confidence(spark, sf):
    p = replies.parse_actions(fx.raw_replies(spark, sf), "raw")
    return p.select("event_id", replies.clamp_confidence("action.confidence").alias("confidence"))


@query
def validate_actions(spark, sf):
    p = replies.parse_actions(fx.raw_replies(spark, sf, valid_types=True), "raw")
    flat = p.select("event_id", "action.action_type", "action.column", "action.confidence")
    return replies.validate_actions(flat)


@query
def truncate_history(spark, sf):
    conv = read_table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return la.last_n(conv, ["conv_id"], "turn", 4)


# --- S1, S4: CSV source and JSON sink through the shared folder -----------------------------

import uuid  # noqa: E402

from scrubspark.session import checkpoint_dir  # noqa: E402
from scrubspark.sources import tables as src  # noqa: E402


def _scratch(spark, tag):
    return f"{checkpoint_dir(spark).rstrip('/')}/scrub-io/{tag}-{uuid.uuid4().hex}"


@query
def csv_roundtrip(spark, sf):
    n = read_table(spark, sf, "nation")
    n = n.withColumn("n_name", F.when(F.col("n_nationkey") % 5 == 0, F.lit("N/A")).otherwise(F.col("n_name")))
    path = _scratch(spark, "nation-csv")
    src.write_csv(n, path)
    back = src.read_csv(spark, path)
    return back.select("n_nationkey", "n_name", "n_regionkey")


@query
def csv_text_roundtrip(spark, sf):
    """Whole documents with line breaks, ids past bigint, booleans and infinities through CSV and back."""
    d = read_table(spark, sf, "documents").select(
        "doc_id", "text", F.concat(F.lit("1234567890123456"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("long_id"),
        F.when(F.col("doc_id") % 2 == 0, F.lit("True")).otherwise(F.lit("False")).alias("even"),
        F.when(F.col("doc_id") % 3 == 0, F.lit("inf")).otherwise(F.lit("1.5")).alias("x"))
    path = _scratch(spark, "documents-csv")
    src.write_csv(d, path)
    back = src.read_csv(spark, path)
    return back.select("doc_id", F.md5("text").alias("text_md5"), "long_id", "even",
                       F.col("x").cast("string").alias("x_text"))


@query
def scores_json_sink(spark, sf):
    a = grading.grade(fx.dirty_orders(spark, sf), specs.ORDERS_SPEC).select(
        F.lit("dirty_orders").alias("table_name"), "score", "passed")
    b = grading.grade(graded_events(spark, sf), specs.EVENTS_SPEC).select(
        F.lit("dirty_events").alias("table_name"), "score", "passed")
    path = _scratch(spark, "scores-json")
    src.write_json(a.unionByName(b), path)
    return spark.read.schema("table_name string, score double, passed boolean").json(path)


# --- streaming: a batch-fitted plan applied to a stream -------------------------------------

from scrubspark.streaming import clean_stream  # noqa: E402


@query
def stream_clean(spark, sf):
    batch = fx.dirty_events(spark, sf)
    fitted = clean_stream.fit_plan(batch, [("fill", "value", "median"), ("clip", "value", "iqr")])
    schema = read_table(spark, sf, "events").schema
    stream = (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
              .option("maxFilesPerTrigger", 1).parquet(sf))
    # The same damage as the batch fixture: projections only, so it runs on a stream.
    from scrubspark.operators import inject as inj
    s = stream.select("event_id", "value")
    s = inj.inject_nulls(s, "value", 0.25, "event_id", "val_null")
    s = inj.inject_outliers(s, "value", 0.08, fx.VALUE_OUTLIERS, "event_id", "val_out", "val_pick")
    cleaned = clean_stream.apply_plan(s, fitted).select("event_id", _r6("value"))
    return clean_stream.run_to_files(cleaned, _scratch(spark, "stream-out"), _scratch(spark, "stream-ckpt"))
