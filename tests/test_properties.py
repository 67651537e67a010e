"""Randomized checks of the distributed algorithms against plain Python.

Each example builds a small table with hot values and ties, forces the
scale paths (tiny task limits, tiny buckets) and compares with a brute force.
"""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from scrubspark.functions.draws import uniform
from scrubspark.operators import inject, stats

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))

# Values drawn from a small pool (ties, a hot value) or freely.
values = st.lists(st.one_of(st.sampled_from([0.0, 1.5, 7.0]),
                            st.floats(-1e6, 1e6, allow_nan=False, allow_infinity=False)),
                  min_size=1, max_size=300)


@SETTINGS
@given(xs=values, limit=st.sampled_from([3, 17, 10**6]),
       probs=st.lists(st.floats(0, 1), min_size=1, max_size=5))
def test_exact_quantiles_equal_numpy(spark, xs, limit, probs):
    df = spark.createDataFrame([(x,) for x in xs], "x double").repartition(3)
    got = stats.quantiles(df, "x", probs, limit=limit)
    assert np.allclose(got, np.quantile(np.array(xs), probs), rtol=1e-12, atol=1e-9)


keys = st.lists(st.one_of(st.just(7), st.integers(0, 10**6)), min_size=1, max_size=300)


@SETTINGS
@given(ks=keys, frac=st.floats(0.0, 1.0))
def test_sample_cut_takes_the_smallest_draws(spark, ks, frac):
    rows = [(k, i % 4) for i, k in enumerate(ks)]
    df = spark.createDataFrame(rows, "k bigint, tag int").repartition(3)
    n = max(1, int(len(rows) * frac))
    got = inject.sample_n(df, n, "k", topk_limit=0).withColumn("_u", uniform("k", "sample")).collect()
    every = df.withColumn("_u", uniform("k", "sample")).collect()
    want = sorted((r["_u"], r["k"]) for r in every)[:n]
    assert sorted((r["_u"], r["k"]) for r in got) == want
    assert df.exceptAll(inject.sample_n(df, n, "k", topk_limit=0)).count() == len(rows) - n


@SETTINGS
@given(ks=keys, per_bucket=st.sampled_from([5, 40, 10**6]))
def test_shuffle_ranks_are_a_sorted_permutation(spark, ks, per_bucket):
    rows = [(k, i) for i, k in enumerate(ks)]
    df = spark.createDataFrame(rows, "k bigint, i bigint").repartition(4)
    out = inject.shuffle_rows(df, "k", rows_per_bucket=per_bucket)
    got = out.withColumn("_u", uniform("k", "shuffle")).orderBy("row_rank").collect()
    assert [r["row_rank"] for r in got] == list(range(len(rows)))
    pairs = [(r["_u"], r["k"]) for r in got]
    assert pairs == sorted(pairs)
    assert sorted(r["i"] for r in got) == list(range(len(rows)))


fill_keys = st.lists(st.tuples(st.one_of(st.none(), st.sampled_from([3, 3, 3, 9]), st.integers(0, 50)),
                               st.one_of(st.none(), st.floats(-100, 100, allow_nan=False))),
                     min_size=1, max_size=300)


@SETTINGS
@given(rows=fill_keys, n_buckets=st.sampled_from([2, 8, 40]))
def test_forward_fill_equals_brute_force(spark, rows, n_buckets):
    from scrubspark.operators import fill
    data = [(i, k, v) for i, (k, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "id bigint, k bigint, v double").repartition(3)
    got = {r["id"]: r["v"] for r in fill.forward_fill(df, "v", ["k", "id"], n_buckets=n_buckets).collect()}
    want, last = {}, None
    for i, k, v in sorted(data, key=lambda r: (r[1] is not None, r[1] if r[1] is not None else 0, r[0])):
        last = v if v is not None else last
        want[i] = last
    assert got == want


def _is_fill_of_some_order(data, got):
    """True when ``got`` (id -> value) is the forward fill of ``data`` (id, k, v)
    under some order of the rows that sorts k ascending, NULL first."""
    groups = {}
    for i, k, v in data:
        groups.setdefault(k, []).append((i, v))
    possible = {None}
    for k in sorted(groups, key=lambda x: (x is not None, x if x is not None else 0)):
        rows = groups[k]
        vals = {v for _, v in rows if v is not None}
        if any(v is not None and got[i] != v for i, v in rows):
            return False
        extra = {got[i] for i, v in rows if v is None} - vals
        if len(extra) > 1 or not extra <= possible:
            return False
        possible = vals if vals else (extra or possible)
    return True


@SETTINGS
@given(rows=fill_keys, n_buckets=st.sampled_from([2, 8, 40]))
def test_forward_fill_with_ties_is_a_fill_of_some_order(spark, rows, n_buckets):
    from scrubspark.operators import fill
    data = [(i, k, v) for i, (k, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "id bigint, k bigint, v double").repartition(3)
    got = {r["id"]: r["v"] for r in fill.forward_fill(df, "v", ["k"], n_buckets=n_buckets).collect()}
    assert _is_fill_of_some_order(data, got)
