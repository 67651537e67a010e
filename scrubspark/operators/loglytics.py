"""Scoring of stored cleaning-action logs.

Input: one row per logged action, many runs, with columns
``run_id, step, action_type, column, confidence, success, noop, null_after,
std_reduction, grade, replay_ok, canonical, irrelevant, max_steps``.

A run ends at its first terminal step (``done`` or ``step + 1 >= max_steps``)
and nothing after it counts, so the map-side filter ``step < max_steps`` comes
first: after it a run whose steps do not repeat has at most ``max_steps`` rows
and is a small window.  Runs in which steps repeat may have any number of rows.
Those with more than ``MOST_IN_A_RUN`` are counted out and scanned over ranges
of (run, step), with the same results: rows of one step are ordered by a hash
of the whole row, in both ways.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scrubspark.operators import scan, stats
from scrubspark.operators.fill import order_ranges
from scrubspark.operators.scan import Fold

# Rows of a run that one task may hold; a log of fewer bytes than the second is not searched for longer runs.
MOST_IN_A_RUN = 100_000
SMALL_LOG_BYTES = 64 << 20

# Reward components.
R_NULL_FIXED = 0.10
R_DTYPE_FIXED = 0.10
R_OUTLIER_CLIPPED = 0.08
R_DUPLICATE_REMOVED = 0.12
R_RENAME_CORRECT = 0.05
R_RENAME_OTHER = 0.025
R_DROP_CORRECT = 0.04
R_DROP_WRONG = -0.025
R_NOOP = -0.05
R_INVALID_OP = -0.03
R_STEP_PENALTY = -0.01
R_DONE_BONUS = 0.15
R_PROVENANCE_BONUS = 0.05
R_EARLY_EXIT = -0.10
R_ORDER_BONUS = 0.02
CONFIDENCE_HIGH = 0.75
CONFIDENCE_BONUS = 0.04
CONFIDENCE_PENALTY = -0.06
QUALITY_THRESHOLD = 0.80
EARLY_EXIT_LAST_STEP = 4
# The causal order dtype -> nulls -> outliers.
CAUSAL_ORDER = ("fix_dtype", "fill_nulls", "clip_outliers")
GUARDED = ("fill_nulls", "remove_duplicates", "fix_dtype", "clip_outliers")
# Breakdown component names, in the order they are recorded.
COMPONENTS = ("step_penalty", "action", "invalid_op", "confidence", "ordering_bonus",
              "early_exit_penalty", "done_bonus", "provenance")


def _run():
    return Window.partitionBy("run_id").orderBy("step")


def _parts(log: DataFrame, most: int, n_ranges: int | None, small: int = SMALL_LOG_BYTES) -> list[DataFrame]:
    """The steps below ``max_steps``: runs that a task can hold, and, where there are any, longer runs cut into ranges."""
    capped = scan.with_tie(log.where(F.col("step") < F.col("max_steps")))
    size = stats.plan_bytes(log)
    if most >= MOST_IN_A_RUN and size is not None and size <= small:
        return [capped]
    hot = scan.hot_groups(capped, ["run_id"], most)
    if hot.isEmpty():
        return [capped]
    same = scan.same_group(["run_id"])
    return [capped.join(hot, same, "left_anti"), scan.cut(capped.join(hot, same, "left_semi"), ["run_id"], ["step"], n_ranges)]


def _until_terminal(part: DataFrame, n_ranges: int | None) -> DataFrame:
    """A8 and the flags of A5 in one scan: a run is kept as a prefix, so what was seen before a kept step is the same."""
    t = F.col("action_type")
    terminal = (t == "done") | (F.col("step") + 1 >= F.col("max_steps"))
    v = scan.scan(part, ["run_id"], ["step"], {
        "terminal_step": Fold(F.when(terminal, F.col("step")), "min", "whole"),
        "__dtype": Fold((t == CAUSAL_ORDER[0]).cast("int"), "max", "before"),
        "__fill": Fold((t == CAUSAL_ORDER[1]).cast("int"), "max", "before")}, n_ranges)
    return (v.where(F.col("terminal_step").isNull() | (F.col("step") <= F.col("terminal_step")))
            .withColumn("is_terminal", F.col("step") == F.col("terminal_step")))


def _all(parts: list[DataFrame], cols: list[str]) -> DataFrame:
    out = parts[0].select(*cols)
    for p in parts[1:]:
        out = out.unionByName(p.select(*cols))
    return out


def valid_steps(log: DataFrame, most: int = MOST_IN_A_RUN, n_ranges: int | None = None) -> DataFrame:
    """Rows up to and including each run's first terminal step."""
    parts = [_until_terminal(p, n_ranges) for p in _parts(log, most, n_ranges)]
    return _all(parts, [*log.columns, "terminal_step", "is_terminal"])


def action_value(c_type: Column = None) -> Column:
    """A1 (and A2 as NULL): the value of a successful action."""
    t = F.col("action_type")
    return (F.when(~F.col("success"), F.lit(None).cast("double"))
            .when(t == "done", F.lit(0.0))
            .when(F.col("noop") & t.isin(*GUARDED), F.lit(R_NOOP))
            .when(t == "fill_nulls", F.lit(R_NULL_FIXED) * (F.lit(1.0) - F.col("null_after")))
            .when(t == "remove_duplicates", F.lit(R_DUPLICATE_REMOVED))
            .when(t == "fix_dtype", F.lit(R_DTYPE_FIXED))
            .when(t == "clip_outliers", F.lit(R_OUTLIER_CLIPPED) * (F.lit(1.0) + F.col("std_reduction")))
            .when(t == "rename_column", F.when(F.col("canonical"), F.lit(R_RENAME_CORRECT))
                  .otherwise(F.lit(R_RENAME_OTHER)))
            .when(t == "drop_column", F.when(F.col("irrelevant"), F.lit(R_DROP_CORRECT))
                  .otherwise(F.lit(R_DROP_WRONG))))


def score_log(log: DataFrame, most: int = MOST_IN_A_RUN, n_ranges: int | None = None) -> DataFrame:
    """A1-A10: every component, the step reward and both running totals."""
    parts = [_score(p, n_ranges) for p in _parts(log, most, n_ranges)]
    return _all(parts, [c for c in parts[0].columns if c not in (scan.TIE, "__dtype", "__fill")])


def _score(part: DataFrame, n_ranges: int | None) -> DataFrame:
    v = _until_terminal(part, n_ranges)
    t = F.col("action_type")
    v = v.withColumn("action_value", action_value())
    outcome = F.coalesce(F.col("action_value"), F.lit(R_INVALID_OP))
    ordered = ((t == CAUSAL_ORDER[0])
               | ((t == CAUSAL_ORDER[1]) & (F.coalesce("__dtype", F.lit(0)) == 1))
               | ((t == CAUSAL_ORDER[2]) & (F.coalesce("__fill", F.lit(0)) == 1)))
    is_done = t == "done"
    v = (v.withColumn("step_penalty", F.lit(R_STEP_PENALTY))
         .withColumn("invalid_op", F.when(~F.col("success"), F.lit(R_INVALID_OP)))
         .withColumn("confidence_term", F.when(F.col("confidence") >= CONFIDENCE_HIGH,
                                               F.when(outcome > 0, F.lit(CONFIDENCE_BONUS))
                                               .otherwise(F.lit(CONFIDENCE_PENALTY))).otherwise(F.lit(0.0)))
         .withColumn("ordering_bonus", F.when(F.col("success") & (F.col("action_value") > 0) & ordered,
                                              F.lit(R_ORDER_BONUS)).otherwise(F.lit(0.0)))
         .withColumn("early_exit_penalty", F.when(is_done & (F.col("step") + 1 <= EARLY_EXIT_LAST_STEP)
                                                  & (F.col("grade") < QUALITY_THRESHOLD), F.lit(R_EARLY_EXIT)))
         .withColumn("done_bonus", F.when(is_done, F.when(F.col("grade") >= QUALITY_THRESHOLD,
                                                          F.lit(R_DONE_BONUS))
                                          .otherwise(F.lit(R_DONE_BONUS) * F.col("grade"))))
         .withColumn("provenance", F.when(is_done, F.when(F.col("replay_ok"), F.lit(R_PROVENANCE_BONUS))
                                          .otherwise(F.lit(0.0)))))
    raw = (F.col("step_penalty") + outcome + F.col("confidence_term") + F.col("ordering_bonus")
           + F.coalesce(F.col("early_exit_penalty"), F.lit(0.0))
           + F.coalesce(F.col("done_bonus"), F.lit(0.0)) + F.coalesce(F.col("provenance"), F.lit(0.0)))
    v = v.withColumn("reward", F.round(raw, 6))
    stored = F.col("reward") - F.coalesce(F.col("early_exit_penalty"), F.lit(0.0))
    v = scan.scan(v, ["run_id"], ["step"], {"cumulative": Fold(F.col("reward"), "sum"), "cumulative_stored": Fold(stored, "sum")},
                  n_ranges)
    return v.withColumns({c: F.round(c, 6) for c in ("cumulative", "cumulative_stored")})


def breakdown(scored: DataFrame) -> Column:
    """A10: the named components of one step as a map (absent ones left out)."""
    entries = F.array(
        F.struct(F.lit("step_penalty").alias("k"), F.col("step_penalty").alias("v")),
        F.struct(F.lit("action").alias("k"), F.col("action_value").alias("v")),
        F.struct(F.lit("invalid_op").alias("k"), F.col("invalid_op").alias("v")),
        F.struct(F.lit("confidence").alias("k"), F.col("confidence_term").alias("v")),
        F.struct(F.lit("ordering_bonus").alias("k"),
                 F.when(F.col("ordering_bonus") > 0, F.col("ordering_bonus")).alias("v")),
        F.struct(F.lit("early_exit_penalty").alias("k"), F.col("early_exit_penalty").alias("v")),
        F.struct(F.lit("done_bonus").alias("k"), F.col("done_bonus").alias("v")),
        F.struct(F.lit("provenance").alias("k"), F.col("provenance").alias("v")),
    )
    return F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))


def dominant_component(bd: Column) -> Column:
    """The key with the largest absolute value, step cost excluded; 'step' when none.

    Ties keep the earlier component: the max is taken over (|v|, -position).
    """
    ents = F.filter(F.map_entries(bd), lambda e: e["key"] != "step_penalty")
    ranked = F.transform(ents, lambda e: F.struct(
        F.abs(e["value"]).alias("a"),
        (-F.array_position(F.array(*[F.lit(c) for c in COMPONENTS]), e["key"])).alias("p"),
        e["key"].alias("k")))
    return F.coalesce(F.array_max(ranked)["k"], F.lit("step"))


def last_n(df: DataFrame, keys: list[str], order: str, n: int, rank_col: str | None = None) -> DataFrame:
    """The last ``n`` rows of every group by ``order``.

    ``row_number() <= n`` lets Spark add a partial WindowGroupLimit before the
    shuffle: each map task forwards at most ``n`` rows per group, so a group
    holding a third of the table does not land whole in one task.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    out = df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n)
    if rank_col:
        return out.withColumnRenamed("__rn", rank_col)
    return out.drop("__rn")


def explain_lines(scored: DataFrame) -> DataFrame:
    """``Step N: action on 'col' -> reward +0.123456.`` per step."""
    col_part = F.when(F.col("column").isNotNull(), F.format_string(" on '%s'", F.col("column"))) \
        .otherwise(F.lit(""))
    line = F.concat(F.format_string("Step %d: %s", (F.col("step") + 1).cast("int"), F.col("action_type")),
                    col_part, F.format_string(" -> reward %+.6f.", F.col("reward")))
    return scored.select("run_id", "step", line.alias("line"))


def moving_average(scored: DataFrame, width: int, value: str = "reward") -> DataFrame:
    """Mean of the last ``width`` rewards per run, full windows only."""
    w = _run().rowsBetween(-(width - 1), 0)
    return (scored.withColumn("__rn", F.row_number().over(_run()))
            .withColumn("moving_avg", F.round(F.avg(value).over(w), 6))
            .where(F.col("__rn") >= width).drop("__rn"))


def smoothing_width(n: Column, share: int = 20, least: int = 10) -> Column:
    """Width of the smoothing window of ``n`` values, NULL when there are too few to smooth."""
    return F.when(n > least, F.greatest(F.lit(1), F.floor(n / share)).cast("int"))


def smoothed(df: DataFrame, keys: list[str], order: str, value: str, n_ranges: int | None = None) -> DataFrame:
    """A14 by its width rule: per group, the mean of the last ``smoothing_width`` values, full windows only.

    The width varies by group, so the mean comes from two running sums: up to the row, and up to ``width``
    rows before it (joined by position).  Groups too short to smooth give no rows.

    The rows are cut into ranges of (keys, order), so a group of any size is spread: positions and sums run
    inside a range, and one row per group and range carries what the group's earlier ranges add.
    """
    by_row = [*[F.col(k) for k in keys], F.col(order), F.xxhash64(*df.columns, *[F.col(c).isNull() for c in df.columns])]
    t = order_ranges(df, by_row, n_ranges)
    parts = t.groupBy("__b", *keys).agg(F.count(F.lit(1)).alias("__n"), F.sum(value).alias("__s"))
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    parts = (parts.withColumn("width", smoothing_width(F.sum("__n").over(whole))).where("width is not null")
             .select(F.col("__b").alias("__pb"), *[F.col(k).alias(f"__p{i}") for i, k in enumerate(keys)], "width",
                     F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__n"), F.sum("__s").over(earlier).alias("__s")))
    by = Window.partitionBy("__b", *keys).orderBy(*by_row)
    sums = F.sum(value).over(by.rowsBetween(Window.unboundedPreceding, 0))
    t = t.withColumn("__rn", F.row_number().over(by)).withColumn("__sum", sums)
    same = F.col("__b") == F.col("__pb")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__p{i}"))
    # A sum is NULL up to the group's first value.
    t = t.join(parts, same).select(*df.columns, "width", (F.col("__rn") + F.col("__n")).alias("__rn"), F.coalesce(
        F.col("__sum") + F.col("__s"), "__sum", "__s").alias("__sum"))
    before = t.select(*[F.col(k).alias(f"__p{i}") for i, k in enumerate(keys)],
                      (F.col("__rn") + F.col("width")).alias("__at"), F.col("__sum").alias("__before"))
    same = F.col("__rn") == F.col("__at")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__p{i}"))
    return (t.where(F.col("__rn") >= F.col("width")).join(before, same, "left")
            .withColumn("moving_avg", (F.col("__sum") - F.coalesce("__before", F.lit(0.0))) / F.col("width"))
            .select(*df.columns, "width", "moving_avg"))


def group_mean(df: DataFrame, keys: list[str], value: str, name: str = "mean_value") -> DataFrame:
    """Mean of ``value`` per group (partial aggregation map-side)."""
    return df.groupBy(*keys).agg(F.round(F.avg(value), 6).alias(name), F.count(F.lit(1)).alias("n"))


def run_summary(scored: DataFrame) -> DataFrame:
    """One row per run: steps, totals, and the terminal step's grade and replay flag."""
    last = F.struct("step", "grade", "replay_ok", "is_terminal", "action_type")
    agg = scored.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("steps"),
        F.round(F.sum("reward"), 6).alias("total_reward"),
        F.round(F.sum(F.col("reward") - F.coalesce(F.col("early_exit_penalty"), F.lit(0.0))), 6)
        .alias("total_reward_stored"),
        F.max_by(last, F.col("step")).alias("last"))
    return agg.select("run_id", "steps", "total_reward", "total_reward_stored",
                      F.col("last.grade").alias("final_grade"), F.col("last.replay_ok").alias("replay_ok"),
                      (F.col("last.action_type") == "done").alias("ended_by_done"))
