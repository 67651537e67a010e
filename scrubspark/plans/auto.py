"""Auto-clean (L3): profile, recommend, apply, until done or out of steps."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubspark.operators import dedup
from scrubspark.operators import grade as grading
from scrubspark.operators import profile as profiling
from scrubspark.operators import stats
from scrubspark.plans.clean import LOG_SCHEMA, _clean
from scrubspark.plans.recommend import next_action
from scrubspark.sources.tables import normalize


def auto_clean(df: DataFrame, spec=None, max_steps: int | None = None, order_by=None,
               exact: bool = True, checkpoint: bool = False):
    """Returns (cleaned DataFrame, log DataFrame, grade DataFrame).

    The driver loop handles one profile (a row per column) per round; the
    table stays distributed.  A (action, column) pair that failed or changed
    nothing is not proposed again, so the loop cannot spin on one choice.
    """
    spec = spec or grading.default_spec()
    max_steps = max_steps or spec.max_steps
    with stats.persisted(df):
        return _auto_clean(df, spec, max_steps, order_by, exact, checkpoint)


# Rows from which changed fingerprints are counted alone; a smaller table is counted whole in the profile's job.
RECOUNT_ROWS = 5_000_000
# Actions that change one column only: the rest of the profile still holds.
ONE_COLUMN = ("fill_nulls", "clip_outliers", "fix_dtype")


class _Round:
    """A table on the way, with its profile, its header and its rows per fingerprint."""

    def __init__(self, df: DataFrame, exact: bool):
        self.exact, self.counts = exact, None
        self.fresh(df)

    def fresh(self, df: DataFrame) -> None:
        """Everything measured anew."""
        self.df = df
        self.prof, self.header = profiling.fit_profile_and_header(df, exact=self.exact, distinct=False, median=True)
        self.close()

    def close(self) -> None:
        if self.counts:
            self.counts.close()
        self.counts = None

    def rewritten(self, df: DataFrame, column: str, rewrite) -> None:
        """One column of every row rewritten by the projection ``rewrite`` (None: of another type): that column is
        profiled again, and of the rows of a large table only those whose fingerprint changed are counted again."""
        n = self.header["n_rows"]
        alone = rewrite is not None and n >= RECOUNT_ROWS
        one, head = profiling.fit_profile_and_header(df, exact=self.exact, columns=[column], distinct=False, header=not alone, median=True)
        if alone:
            if self.counts is None:
                self.counts = dedup.RowCounts(self.df, self.df.columns, {"rows": n, "distinct": self.header["n_distinct"]})
            distinct = self.counts.change(self.df, column, rewrite)
            head = dict(self.header, n_distinct=distinct, duplicate_rate=0.0 if n == 0 else (n - distinct) / n)
        else:
            self.close()
        self.header, self.df = head, df
        self.prof = [one[0] if d["name"] == column else d for d in self.prof]

    def column(self, name: str | None) -> dict | None:
        return next((d for d in self.prof if d["name"] == name), None)


def _auto_clean(df, spec, max_steps, order_by, exact, checkpoint):
    spark = df.sparkSession
    logs, skip, held = [], set(), []
    at = _Round(normalize(df), exact)
    for step in range(max_steps):
        action = next_action(at.prof, at.header, skip)
        again = step + 1 < max_steps
        known = {"header": at.header, "column": at.column(action.column), "measured_next": again}
        state, log = _clean(at.df, [action], spec, order_by, exact, checkpoint, step, rows=at.header["n_rows"], known=known)
        logs += log
        row = dict(zip(LOG_SCHEMA.names, log[0]))
        if not row["success"] or row["noop"]:
            skip.add((action.action_type, action.column))
        elif again and action.action_type in ONE_COLUMN:
            # A projection over the table held: nothing to materialise.
            same = state.df.schema[action.column].dataType == at.df.schema[action.column].dataType
            at.rewritten(state.df, action.column, state.rewrite if same else None)
            if action.action_type == "fill_nulls":
                logs[-1] = tuple(at.column(action.column)["null_rate"] if n == "null_after" else v for n, v in zip(LOG_SCHEMA.names, logs[-1]))
        elif again and action.action_type != "done":
            # Rows change: materialised once, and every later statistic reads it.
            at.fresh(state.df.persist(StorageLevel.MEMORY_AND_DISK))
            for h in held:
                h.unpersist()
            held = [at.df]
        else:
            at.df = state.df
        if action.action_type == "done":
            break
    at.close()
    g = grading.grade(at.df, spec, exact, at.header, at.prof).withColumn("steps", F.lit(len(logs)))
    for h in held:
        h.unpersist()
    return at.df, stats.local_frame(spark, logs, LOG_SCHEMA), g
