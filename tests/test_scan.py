"""Running state over groups of any size: ranges and carries against plain loops."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from scrubspark.functions.refusals import Refusal
from scrubspark.operators import loglytics as la
from scrubspark.operators import scan
from scrubspark.operators.scan import Fold

from .test_loglytics import COLS, row

FOLDS = {"s": ("sum", "upto"), "sb": ("sum", "before"), "m": ("max", "before"), "w": ("min", "whole"), "sw": ("sum", "whole")}


def _loop(rows):
    """{id: folds} of (id, group, step, value) by one pass over each group in order."""
    out = {}
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (str(r[1]), r[2])), key=lambda r: str(r[1])):
        group = list(group)
        whole = [r[3] for r in group if r[3] is not None]
        seen = []
        for r in group:
            before = list(seen)
            seen += [r[3]] if r[3] is not None else []
            out[r[0]] = (sum(seen) if seen else None, sum(before) if before else None, max(before, default=None),
                         min(whole, default=None), sum(whole) if whole else None)
    return out


@pytest.mark.parametrize("ranges", [None, 1, 5, 40])
def test_scan_equals_a_loop_over_each_group(spark, ranges):
    rnd = random.Random(2)
    sizes = [("hot", 600), (None, 150), ("a", 1), ("b", 40), ("z", 90), ("nulls", 5)]
    rows = [(f"{g}{i}", g, i, None if g == "nulls" or rnd.random() < 0.2 else rnd.randint(-50, 50)) for g, n in sizes for i in range(n)]
    rnd.shuffle(rows)
    # Names that a helper column could have taken.
    df = scan.with_tie(spark.createDataFrame([(*r, 1, 2) for r in rows], "id string, g string, i int, v int, k0 int, b int").repartition(6))
    t = df if ranges is None else scan.cut(df, ["g"], ["i"], ranges)
    got = scan.scan(t, ["g"], ["i"], {n: Fold(F.col("v"), how, reach) for n, (how, reach) in FOLDS.items()}, ranges)
    found = got.select("id", *FOLDS).collect()
    assert len(found) == len(rows)
    assert {r["id"]: tuple(r)[1:] for r in found} == _loop(rows)


def test_scan_of_two_keys_and_of_no_rows(spark):
    df = scan.with_tie(spark.createDataFrame([(i % 2, None if i % 3 else "x", i, 1) for i in range(60)], "a int, c string, i int, v int"))
    folds = {"n": Fold(F.col("v"), "sum")}
    plain = {r["i"]: r["n"] for r in scan.scan(df, ["a", "c"], ["i"], folds).collect()}
    cut = scan.cut(df, ["a", "c"], ["i"], 9)
    assert {r["i"]: r["n"] for r in scan.scan(cut, ["a", "c"], ["i"], folds, 9).collect()} == plain
    none = scan.cut(df.where("i < 0"), ["a"], ["i"], 3)
    assert scan.scan(none, ["a"], ["i"], folds, 3).count() == 0


def test_unknown_fold_is_refused():
    with pytest.raises(Refusal):
        Fold(None, "avg")


def _log(spark, hot=3000):
    rnd = random.Random(9)
    kinds = ["fix_dtype", "fill_nulls", "clip_outliers", "drop_column"]

    def step(run, at):
        return row(run, at, rnd.choice(kinds), conf=rnd.random(), ok=rnd.random() < 0.9, na=round(rnd.random(), 3), sr=round(rnd.random(), 3))
    rows = [step(7, rnd.randint(0, 12)) for _ in range(hot)] + [row(7, 13, "done"), row(7, 14, "drop_column")]
    rows += [step(None, rnd.randint(0, 5)) for _ in range(hot // 4)]
    rows += [step(run, at) for run in range(20, 60) for at in range(8)]
    return spark.createDataFrame(rows, COLS).repartition(5)


def test_hot_runs_score_as_small_ones_do(spark):
    log = _log(spark)
    plain, split = la.score_log(log), la.score_log(log, most=500, n_ranges=8)
    assert plain.columns == split.columns and plain.count() == split.count()
    assert plain.exceptAll(split).isEmpty()
    assert la.valid_steps(log).exceptAll(la.valid_steps(log, most=500, n_ranges=8)).isEmpty()


def test_a_hot_run_is_spread_over_ranges(spark):
    plain, hot = la._parts(_log(spark, 6000), 500, 8)
    counts = [r["count"] for r in hot.groupBy(scan.RANGE).count().collect()]
    assert len(counts) == 8 and max(counts) <= 4 * sum(counts) / 8
    assert {r[0] for r in hot.select("run_id").distinct().collect()} == {7, None}
    assert plain.where("run_id = 7 or run_id is null").isEmpty()


def test_no_hot_run_leaves_one_plain_part(spark):
    log = _log(spark, 40)
    assert len(la._parts(log, 500, 8)) == 1 and len(la._parts(log, la.MOST_IN_A_RUN, None)) == 1
