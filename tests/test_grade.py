import numpy as np
import pytest
from pyspark.sql import functions as F

from scrubspark.operators import grade as G
from scrubspark.operators import profile as P
from scrubspark.operators import quality as Q

from .conftest import SF_SMALL


def spec(**kw):
    return G.GradeSpec(**kw)


def test_type_check(spark):
    num = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "a double")
    txt = spark.createDataFrame([("x",), ("y",), ("z",)], "a string")
    assert G.type_credit(num.schema, {"a": "numeric"}) == 1.0
    assert G.type_credit(txt.schema, {"a": "numeric"}) == 0.0
    assert G.type_credit(txt.schema, {"b": "numeric"}) == 0.0
    assert G.type_credit(txt.schema, {}) == 1.0


def test_dup_check(spark):
    uniq = spark.createDataFrame([(i,) for i in range(100)], "a bigint")
    dups = spark.createDataFrame([(1,)] * 50 + [(2,)] * 50, "a bigint")
    assert G.fit_grade(uniq, spec())["dup_check"] == 1.0
    assert G.fit_grade(dups, spec())["dup_check"] < 1.0


def test_null_check(spark):
    full = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "a double")
    holes = spark.createDataFrame([(1.0,), (None,), (None,), (None,)], "a double")
    assert G.fit_grade(full, spec(null_cols=["a"]))["null_check"] == 1.0
    assert G.fit_grade(holes, spec(null_cols=["a"]))["null_check"] < 1.0
    assert G.fit_grade(full, spec(null_cols=["zz"]))["null_check"] == 0.0


def test_outlier_check_on_normal_data(spark):
    vals = np.random.default_rng(0).normal(0, 1, 1000)
    df = spark.createDataFrame([(float(v),) for v in vals], "a double")
    assert G.fit_grade(df, spec(outlier_cols=["a"]))["outlier_check"] >= 0.9


def test_range_rules(spark):
    ok = spark.createDataFrame([(20,), (30,), (40,), (50,)], "age bigint")
    bad = spark.createDataFrame([(200,), (300,), (400,)], "age bigint")
    r = {"age": (18, 100)}
    assert G.fit_grade(ok, spec(rules=r))["rule_check"] == 1.0
    assert G.fit_grade(bad, spec(rules=r))["rule_check"] == 0.0
    assert G.bounds((None, 5)) == (float("-inf"), 5.0)


def test_weighted_grade_in_unit_interval_and_drop_bonus(spark):
    df = spark.createDataFrame([(1.0, "x")] * 3 + [(None, "y")], "a double, b string")
    s = spec(null_cols=["a"], type_expect={"a": "numeric"}, outlier_cols=["a"], rules={"a": (0, None)},
             irrelevant=["gone"], weights={"null": .2, "type": .2, "outlier": .2, "dup": .15, "rules": .2})
    g = G.fit_grade(df, s)
    assert 0.0 <= g["score"] <= 1.0 and g["drop_bonus"] == 0.05
    assert G.grade(df, s).columns == G.GRADE_COLUMNS


def test_default_grade(spark):
    df = spark.createDataFrame([(1.0,), (None,), (1.0,), (2.0,)], "a double")
    g = G.fit_grade(df, G.default_spec())
    assert g["score"] == round(((1 - 0.25) + (1 - 0.25)) / 2, 4)


def test_profile_flags_and_quality_on_fixture(spark):
    from scrubspark.catalog import fixtures as fx
    d = fx.dirty_orders(spark, SF_SMALL)
    prof = {p["name"]: p for p in P.fit_profile(d)}
    assert "heavy_nulls" in prof["o_totalprice"]["flags"]
    assert "type_chaos" in prof["qty_text"]["flags"]
    q = Q.quality_scores(P.profile(d), P.table_header(d)).first()
    assert 0 < q["overall"] < 1 and q["type_score"] == round(1 - 1 / 3, 4)


def test_empty_table_is_guarded(spark):
    df = spark.createDataFrame([], "a double, b string")
    prof = P.fit_profile(df)
    assert prof[0]["null_rate"] == 0.0 and P.fit_header(df)["duplicate_rate"] == 0.0
    assert G.fit_grade(df, G.default_spec())["score"] == 1.0


def test_quality_band(spark):
    df = spark.createDataFrame([(0.9,), (0.7,), (0.1,)], "q double")
    assert [r[0] for r in df.select(Q.quality_band("q")).collect()] == ["good", "warn", "bad"]


def test_profile_samples_are_first_by_order(spark):
    df = spark.createDataFrame([(3, "c"), (1, None), (2, "b"), (0, "a"), (4, "d")], "k bigint, v string")
    got = P.sample_values(df, ["k"], 3)
    assert got["v"] == ["a", "b", "c"] and got["k"] == ["0", "1", "2"]


def test_samples_of_a_sparse_column_come_from_all_rows(spark):
    df = spark.range(5000).select(F.col("id").alias("k"), F.when(F.col("id") >= 4990, F.col("id")).alias("v"),
                                  F.lit(None).cast("string").alias("none"))
    got = P.sample_values(df.repartition(7), ["k"], 3)
    assert got == {"k": ["0", "1", "2"], "v": ["4990", "4991", "4992"], "none": []}


def test_distinct_counts_in_groups(spark):
    df = spark.range(1000).select(*[(F.col("id") % m).alias(f"c{m}") for m in (1, 3, 7, 10, 11, 13, 1000)],
                                  F.when(F.col("id") % 2 == 0, F.col("id") % 5).alias("n"))
    assert P.distinct_counts(df, df.columns) == {"c1": 1, "c3": 3, "c7": 7, "c10": 10, "c11": 11, "c13": 13,
                                                 "c1000": 1000, "n": 5}
    assert all(d["n_unique"] is None for d in P.fit_profile_and_header(df, distinct=False)[0])
