import pytest
from pyspark.sql import functions as F

from scrubspark.operators import loglytics as la

COLS = ("run_id bigint, step bigint, action_type string, column string, confidence double, success boolean, "
        "noop boolean, null_after double, std_reduction double, grade double, replay_ok boolean, "
        "canonical boolean, irrelevant boolean, max_steps int")


def row(run, step, at, conf=0.5, ok=True, noop=False, na=0.0, sr=0.0, grade=0.9, rep=True, mx=20):
    return (run, step, at, "c", conf, ok, noop, na, sr, grade, rep, False, True, mx)


@pytest.fixture
def scored(spark):
    log = spark.createDataFrame([
        row(1, 0, "remove_duplicates", conf=0.9),       # 0.12 + confident bonus
        row(1, 1, "fill_nulls", na=0.1),                 # no dtype before: no ordering bonus
        row(1, 2, "fix_dtype", conf=0.9, ok=False),     # failure: -0.03, confident penalty
        row(1, 3, "clip_outliers", sr=0.5),              # fill seen before: ordering bonus
        row(1, 4, "done", grade=0.9),                    # done bonus + provenance
        row(1, 5, "drop_column"),                        # after the terminal step: dropped
        row(2, 0, "done", conf=0.9, grade=0.5, rep=False),  # early exit; confident done is penalised
        row(3, 0, "fix_dtype"), row(3, 1, "fill_nulls", noop=True), row(3, 2, "drop_column", mx=3),
        row(3, 3, "drop_column", mx=3),
    ], COLS)
    return {(r["run_id"], r["step"]): r for r in la.score_log(log).collect()}


def test_terminal_cut(scored):
    assert (1, 5) not in scored and (3, 3) not in scored and (3, 2) in scored


def test_components(scored):
    assert scored[(1, 0)]["reward"] == pytest.approx(-0.01 + 0.12 + 0.04)
    assert scored[(1, 1)]["reward"] == pytest.approx(-0.01 + 0.09)
    assert scored[(1, 2)]["reward"] == pytest.approx(-0.01 - 0.03 - 0.06)
    assert scored[(1, 3)]["ordering_bonus"] == 0.02
    assert scored[(1, 3)]["reward"] == pytest.approx(-0.01 + 0.12 + 0.02)
    assert scored[(1, 4)]["reward"] == pytest.approx(-0.01 + 0.15 + 0.05)
    assert scored[(3, 0)]["ordering_bonus"] == 0.02
    assert scored[(3, 1)]["action_value"] == -0.05 and scored[(3, 1)]["ordering_bonus"] == 0.0


def test_early_exit_and_stored_total(scored):
    r = scored[(2, 0)]
    assert r["early_exit_penalty"] == -0.10
    assert r["reward"] == pytest.approx(-0.01 + 0.0 - 0.06 - 0.10 + 0.15 * 0.5)
    assert r["cumulative_stored"] == pytest.approx(r["cumulative"] + 0.10)


def test_dominant_component(spark, scored):
    log = spark.createDataFrame([row(1, 0, "remove_duplicates", conf=0.9)], COLS)
    s = la.score_log(log)
    out = s.select(la.dominant_component(la.breakdown(s)).alias("d"),
                   F.map_keys(la.breakdown(s)).alias("k")).first()
    assert out["d"] == "action" and out["k"] == ["step_penalty", "action", "confidence"]


def test_moving_average_and_summary(spark):
    log = spark.createDataFrame([row(1, i, "remove_duplicates") for i in range(5)], COLS)
    s = la.score_log(log)
    assert la.moving_average(s, 3).count() == 3
    summ = la.run_summary(s).first()
    assert summ["steps"] == 5 and summ["ended_by_done"] is False


def test_last_n_cuts_before_the_shuffle(spark):
    from .conftest import SF_CHECK, plan_text
    conv = spark.read.parquet(f"{SF_CHECK}/conversations.parquet")
    out = la.last_n(conv, ["conv_id"], "turn", 4)
    out.write.format("noop").mode("overwrite").save()
    assert "WindowGroupLimit" in plan_text(out)
    assert out.groupBy("conv_id").count().agg(F.max("count")).first()[0] <= 4


def test_smoothing_follows_the_length_of_a_group(spark):
    rows = [("long", i, float(i)) for i in range(60)] + [("short", i, 1.0) for i in range(10)] + \
           [("mid", i, float(i)) for i in range(11)]
    df = spark.createDataFrame(rows, "g string, i int, v double")
    out = {(r["g"], r["i"]): (r["width"], r["moving_avg"]) for r in la.smoothed(df, ["g"], "i", "v").collect()}
    assert {g for g, _ in out} == {"long", "mid"}
    assert out[("long", 2)] == (3, 1.0) and out[("long", 59)] == (3, 58.0) and ("long", 1) not in out
    assert out[("mid", 0)] == (1, 0.0) and len([1 for g, _ in out if g == "mid"]) == 11


@pytest.mark.parametrize("ranges", [1, 4, 23])
def test_smoothing_of_a_group_cut_into_ranges(spark, ranges):
    rows = [(g, i, None if g == "hot" and i < 3 else float(i * 7 % 11)) for g, n in (("hot", 400), ("mid", 45), (None, 30), ("few", 9))
            for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i int, v double").repartition(5)
    out = {(r["g"], r["i"]): (r["width"], r["moving_avg"]) for r in la.smoothed(df, ["g"], "i", "v", ranges).collect()}
    want = {}
    for g, n in (("hot", 400), ("mid", 45), (None, 30)):
        v, w = [x or 0.0 for k, _, x in rows if k == g], max(1, n // 20)
        want.update({(g, i): (w, sum(v[i - w + 1:i + 1]) / w) for i in range(w - 1, n)})
    assert out.keys() == want.keys()
    assert all(out[k][0] == want[k][0] and out[k][1] == pytest.approx(want[k][1]) for k in want)
