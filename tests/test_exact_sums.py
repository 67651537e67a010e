"""Sums that no order of partial results changes, and the digest in full that they allow."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from scrubspark.catalog import fixtures as fx
from scrubspark.catalog import specs
from scrubspark.operators import exact_sums, stats
from scrubspark.plans import replay as R
from scrubspark.plans.actions import Action
from scrubspark.plans.clean import clean

from .conftest import SF_SMALL


def _frame(spark, values, parts=3):
    return spark.createDataFrame([(v,) for v in values], "x double").repartition(parts)


def _exact(values):
    n = len(values)
    s = sum(map(Fraction, values))
    var = (sum(Fraction(v) ** 2 for v in values) - s * s / n) / (n - 1)
    return float(s / n), math.sqrt(var)


@pytest.mark.parametrize("scale", [1.0, 1e-300, 1e290, 1e-310])
def test_mean_is_correctly_rounded_and_deviation_within_a_bit(spark, scale):
    rnd = random.Random(7)
    values = [rnd.uniform(-1, 1) * 10 ** rnd.randint(-9, 9) * scale for _ in range(3000)]
    got = stats.moments(_frame(spark, values), ["x"])["x"]
    # A deviation is compared on values of a common scale, where its square is in range.
    std = _exact([v / scale for v in values])[1]
    assert got["mean"] == float(sum(map(Fraction, values)) / len(values))
    assert got["std"] == pytest.approx(std * scale, rel=1e-14 if scale > 1e-300 else 1e-9)


def test_no_cancellation_far_from_zero(spark):
    values = [1e9 + k * 1e-6 for k in range(2000)]
    got = stats.moments(_frame(spark, values), ["x"])["x"]
    mean, std = _exact(values)
    assert (got["mean"], got["std"]) == (mean, pytest.approx(std, rel=1e-15))


def test_moments_are_bit_equal_on_any_partitioning(spark):
    rnd = random.Random(3)
    values = [rnd.gauss(0, 1) * 10 ** rnd.randint(-6, 6) for _ in range(5000)]
    seen = set()
    for parts in (1, 3, 7, 16):
        rnd.shuffle(values)
        m = stats.moments(_frame(spark, values, parts), ["x"])["x"]
        seen.add((m["mean"], m["std"]))
    assert len(seen) == 1


def test_narrow_slices_of_many_rows_give_the_same_sums(spark, monkeypatch):
    values = [math.sin(k) * 10 ** (k % 11) for k in range(800)]
    wide = stats.moments(_frame(spark, values), ["x"])["x"]
    monkeypatch.setattr(exact_sums, "slice_width", lambda n: 20)  # as for 2^42 rows
    assert stats.moments(_frame(spark, values), ["x"])["x"] == wide


def test_slices_of_any_row_count_fit_a_bigint():
    for n in (1, 2, 1000, 10**9, 2**40, 10**15):
        assert n * 2 ** exact_sums.slice_width(n) <= 2**62


@pytest.mark.parametrize("values, mean, std", [
    ([], None, None), ([None, math.nan], None, None), ([2.5, None], 2.5, 0.0), ([-0.0, 0.0], 0.0, 0.0),
    ([3.0, 3.0, 3.0], 3.0, 0.0), ([math.inf, 1.0], math.inf, math.nan), ([math.inf, -math.inf], math.nan, math.nan),
    ([5e-324, 0.0, 0.0], 0.0, 5e-324), ([1.7e308, -1.7e308], 0.0, math.inf)])
def test_edges(spark, values, mean, std):
    m = stats.moments(_frame(spark, values, 2), ["x"])["x"]
    for got, want in ((m["mean"], mean), (m["std"], std)):
        assert got == want or (isinstance(want, float) and math.isnan(want) and math.isnan(got))


def test_fused_and_single_fits_agree_to_the_last_bit(spark):
    raw = fx.dirty_orders(spark, SF_SMALL)
    plan = [Action("fill_nulls", "o_totalprice", {"strategy": "mean"}),
            Action("clip_outliers", "o_custkey", {"method": "zscore", "threshold": 1.5})]
    digests = {R.digest(clean(raw, plan, specs.ORDERS_SPEC, fuse=fuse)[0]).first() for fuse in (True, False)}
    assert len(digests) == 1


@pytest.mark.parametrize("parts", [3, 7])
def test_replay_of_fitted_sums_verifies_in_full(spark, parts):
    raw = fx.dirty_orders(spark, SF_SMALL)
    plan = [Action("fill_nulls", "o_totalprice", {"strategy": "mean"}),
            Action("clip_outliers", "o_totalprice", {"method": "zscore", "threshold": 2.0})]
    out, log = clean(raw, plan, specs.ORDERS_SPEC)
    assert R.verify(raw.repartition(parts), log, out, specs.ORDERS_SPEC).first()["replay_ok"]


@pytest.mark.parametrize("value", [0.3, 123456.789, 1e-9, 2.0**-32, 2.0**32, 1e-40, 1e300, 5e-324, -7.25])
def test_digest_tells_the_last_bit_apart(spark, value):
    near = math.nextafter(value, math.inf)
    a, b = (R.digest(spark.createDataFrame([(v,)], "x double")).first()["digest"] for v in (value, near))
    assert a != b


def test_texts_of_doubles_are_exact(spark):
    rnd = random.Random(5)
    values = [rnd.uniform(-2, 2) * 2.0 ** rnd.randint(-1070, 1020) for _ in range(2000)] + [
        0.0, 5e-324, -5e-324, 1.7976931348623157e308, 2.0**32, 2.0**-32, math.nextafter(2.0**32, 0)]
    d = spark.createDataFrame([(v,) for v in values], "x double")
    texts = [r["f0"] for r in R.rendered(d).collect()]
    for v, t in zip(values, texts):
        n, text = t.split(":", 1)
        e, whole, upper, lower = map(int, text.split(":"))
        read = (Fraction(whole) + Fraction(upper, 1 << 42) + Fraction(lower, 1 << 84)) * Fraction(2) ** e
        assert int(n) == len(text) and read == Fraction(v)


def test_texts_of_special_cells(spark):
    d = spark.createDataFrame([(None, None), (math.nan, 0.5), (-math.inf, 0.5), (-0.0, 0.5)], "x double, `a.b``c` float")
    got = [tuple(r) for r in R.rendered(d).collect()]
    half = got[1][1]
    assert got == [("~", "~"), ("3:nan", half), ("4:-inf", half), ("7:0:0:0:0", half)]
    assert R.digest(d.limit(0)).select(F.col("n_rows")).first()["n_rows"] == 0
