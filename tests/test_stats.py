import numpy as np
import pytest
from pyspark.sql import functions as F

from scrubspark.operators import stats

from .conftest import SF_CHECK


@pytest.fixture(scope="module")
def prices(spark):
    return spark.read.parquet(f"{SF_CHECK}/orders.parquet").select("o_orderkey", "o_totalprice")


@pytest.mark.parametrize("limit", [10**6, 500, 20])
def test_exact_quantiles_match_numpy(spark, prices, limit):
    arr = np.array([r[0] for r in prices.select("o_totalprice").collect()])
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = stats.quantiles(prices, "o_totalprice", probs, limit=limit)
    assert np.allclose(got, np.quantile(arr, probs), rtol=0, atol=1e-6)


def test_quantiles_with_a_hot_value(spark, prices):
    # a third of all rows share one value: refinement must still be exact
    d = prices.select(F.when(F.col("o_orderkey") % 3 == 0, F.lit(5.0)).otherwise(F.col("o_totalprice")).alias("x"))
    arr = np.array([r[0] for r in d.collect()])
    probs = [0.1, 0.3, 0.5, 0.9]
    assert np.allclose(stats.quantiles(d, "x", probs, limit=100), np.quantile(arr, probs), atol=1e-6)


def test_large_columns_need_three_passes(spark, prices, monkeypatch):
    """Sketch, counts and one sorted list; the passes are counted as reads of the data."""
    reads = []
    for name in ("_brackets", "_quantile_sketches"):
        whole = getattr(stats, name)
        monkeypatch.setattr(stats, name, lambda *a, f=whole, n=name: (reads.append(n), f(*a))[1])
    arr = np.array([r[0] for r in prices.select("o_totalprice").collect()])
    probs = [0.01, 0.25, 0.5, 0.75, 0.99]
    got = stats.quantiles_many(prices, ["o_totalprice", "o_orderkey"], probs, limit=2000)
    assert np.allclose(got["o_totalprice"], np.quantile(arr, probs), rtol=0, atol=1e-9)
    assert reads.count("_quantile_sketches") == 1


@pytest.mark.parametrize("k", [200])
def test_coarse_sketches_change_no_result(spark, prices, monkeypatch, k):
    # Coarse sketches leave wide brackets: they are written and narrowed again.
    monkeypatch.setattr(stats, "SKETCH_K", k)
    d = prices.select(F.when(F.col("o_orderkey") % 3 == 0, F.lit(5.0)).when(F.col("o_orderkey") % 5 == 0, F.lit(150000.0))
                      .otherwise(F.col("o_totalprice")).alias("x")).repartition(7)
    arr = np.array([r[0] for r in d.collect()])
    probs = [0.0, 0.2, 0.33, 0.34, 0.5, 0.6, 0.95, 1.0]
    assert np.allclose(stats.quantiles(d, "x", probs, limit=50), np.quantile(arr, probs), rtol=0, atol=1e-9)


def test_a_missed_bracket_is_widened(spark, prices, monkeypatch):
    right, margins = stats._brackets, []

    def wrong_at_first(df, columns, wins, margin):
        margins.append(margin)
        return [(-2.0, -1.0) for _ in wins] if len(margins) == 1 else right(df, columns, wins, margin)
    monkeypatch.setattr(stats, "_brackets", wrong_at_first)
    arr = np.array([r[0] for r in prices.select("o_totalprice").collect()])
    assert np.allclose(stats.quantiles(prices, "o_totalprice", [0.1, 0.9], limit=5000), np.quantile(arr, [0.1, 0.9]))
    assert margins[1] == 4 * margins[0]


@pytest.mark.parametrize("values", [[7.0] * 60, [1.0, 2.0] * 40, [float("-inf"), 0.0, -0.0, float("inf")] * 20])
def test_ties_and_infinities(spark, values):
    d = spark.createDataFrame([(v,) for v in values], "x double")
    n = len(values)
    got = stats.select_ranks(d.select(F.col("x").alias("v")), n, list(range(n)), limit=10)
    assert [got[r] for r in range(n)] == sorted(values)


def test_quantiles_many_columns_one_call(spark, prices):
    arr = np.array([r[0] for r in prices.select("o_totalprice").collect()])
    keys = np.array([r[0] for r in prices.select("o_orderkey").collect()], dtype=float)
    got = stats.quantiles_many(prices, ["o_totalprice", "o_orderkey"], [0.25, 0.75])
    assert np.allclose(got["o_totalprice"], np.quantile(arr, [0.25, 0.75]))
    assert np.allclose(got["o_orderkey"], np.quantile(keys, [0.25, 0.75]))


def test_quantiles_ignore_nulls_and_nan(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "x double")
    assert stats.quantiles(df, "x", [0.5]) == [2.0]


def test_quantiles_empty_column(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert stats.quantiles(df, "x", [0.25, 0.75]) == [None, None]


def test_approximate_quantiles_are_close(spark, prices):
    arr = np.array([r[0] for r in prices.select("o_totalprice").collect()])
    got = stats.quantiles(prices, "o_totalprice", [0.5], exact=False)[0]
    assert abs(np.searchsorted(np.sort(arr), got) / len(arr) - 0.5) < 0.01


def test_mode_ties_go_to_smallest(spark):
    num = spark.createDataFrame([(2,), (2,), (1,), (1,), (3,)], "x bigint")
    txt = spark.createDataFrame([("b",), ("b",), ("a",), ("a",)], "x string")
    assert stats.mode_value(num, "x") == 1
    assert stats.mode_value(txt, "x") == "a"


def test_std_of_one_value_is_zero(spark):
    df = spark.createDataFrame([(4.0,), (None,)], "x double")
    m = stats.moments(df, ["x"])["x"]
    assert m["std"] == 0.0 and m["mean"] == 4.0 and m["nulls"] == 1
