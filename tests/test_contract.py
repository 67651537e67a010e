import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

from scrubspark.catalog import fixtures as fx
from scrubspark.operators import inject

from .conftest import SF_SMALL


def test_entry_runs_on_smoke_data(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "o_totalprice" in df.columns


def test_every_query_has_an_oracle():
    missing = {q for q in set(entry.queries()) - set(entry.oracle_sql()) if q != "pipeline" and not q.startswith("op")}
    assert not missing


def test_fixture_draws_do_not_depend_on_partitioning(spark):
    a = fx.dirty_orders(spark, SF_SMALL)
    b = fx.dirty_orders(spark, SF_SMALL)
    b = b.repartition(5)
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_injection_rates_are_close(spark):
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    n = o.count()
    nulls = inject.inject_nulls(o, "o_totalprice", 0.3, "o_orderkey", "t").where("o_totalprice is null").count()
    assert abs(nulls / n - 0.3) < 0.05
    assert inject.sample_n(o, 100, "o_orderkey").count() == 100
    ranks = sorted(r[0] for r in inject.shuffle_rows(o, "o_orderkey").select("row_rank").collect())
    assert ranks == list(range(n))


def _brute_sample(rows, n, key):
    """The n smallest (draw, key) pairs of the collected rows, in plain Python."""
    ordered = sorted(rows, key=lambda r: (r["_u"], r[key] is not None, r[key]))
    return sorted((r["_u"], r[key]) for r in ordered[:n])


def test_large_sample_cut_equals_top_k(spark):
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet").select("o_orderkey", "o_totalprice")
    a = inject.sample_n(o, 700, "o_orderkey", topk_limit=0)
    b = inject.sample_n(o, 700, "o_orderkey")
    assert a.count() == 700 and a.exceptAll(b).count() == 0


def test_large_sample_with_a_hot_key(spark):
    """A third of the rows share one key (so one draw); some of them are exact
    copies.  The cut must still return exactly n rows, the right (draw, key)
    pairs, and only rows of the input."""
    from pyspark.sql import functions as F
    from scrubspark.functions.draws import uniform
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet").select("o_orderkey", "o_custkey")
    n_rows = o.count()
    hot = F.when(F.col("o_orderkey") % 3 == 0, F.lit(7)).otherwise(F.col("o_orderkey"))
    d = o.withColumn("o_orderkey", hot).withColumn(
        "o_custkey", F.when(F.col("o_orderkey") == 7, F.col("o_custkey") % 5).otherwise(F.col("o_custkey")))
    rows = d.withColumn("_u", uniform("o_orderkey", "sample")).collect()
    hot_u = uniform(F.lit(7), "sample")
    below_hot = d.where(uniform("o_orderkey", "sample") < spark.range(1).select(hot_u).first()[0]).count()
    for n in (below_hot + 1, below_hot + n_rows // 6, n_rows - 3):
        got = inject.sample_n(d, n, "o_orderkey", topk_limit=0)
        got_rows = got.withColumn("_u", uniform("o_orderkey", "sample")).collect()
        assert len(got_rows) == n
        assert sorted((r["_u"], r["o_orderkey"]) for r in got_rows) == _brute_sample(rows, n, "o_orderkey")
        assert got.exceptAll(d).count() == 0


def test_shuffle_ranks_with_a_hot_key(spark):
    """Ranks stay a permutation of 0..n-1 in (draw, key) order when a third of
    the rows share one key, with buckets small enough that the hot group is
    split across sub-buckets."""
    from pyspark.sql import functions as F
    from scrubspark.functions.draws import uniform
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet").select("o_orderkey", "o_custkey").repartition(6)
    hot = F.when(F.col("o_orderkey") % 3 == 0, F.lit(7)).otherwise(F.col("o_orderkey"))
    d = o.withColumn("o_orderkey", hot)
    n = d.count()
    out = inject.shuffle_rows(d, "o_orderkey", rows_per_bucket=50)
    rows = out.withColumn("_u", uniform("o_orderkey", "shuffle")).orderBy("row_rank").collect()
    assert [r["row_rank"] for r in rows] == list(range(n))
    pairs = [(r["_u"], r["o_orderkey"]) for r in rows]
    assert pairs == sorted(pairs)
    assert out.drop("row_rank").exceptAll(d).count() == 0


def test_wide_inputs_skip_the_top_k_merge(spark, monkeypatch):
    """When partitions x n passes the merge budget, the sample is the exact
    cut (no TakeOrderedAndProject) and holds the same rows."""
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet").select("o_orderkey", "o_totalprice")
    want = inject.sample_n(o, 300, "o_orderkey")
    assert "TakeOrderedAndProject" in want._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(inject, "TOPK_MERGE_ROWS", 10)
    monkeypatch.setattr(inject, "TOPK_LIMIT", 10)
    got = inject.sample_n(o, 300, "o_orderkey", topk_limit=100_000)
    assert "TakeOrderedAndProject" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 300 and got.exceptAll(want).count() == 0


def test_shuffle_ranks_with_many_hot_keys(spark):
    """Half the rows fall on 20 keys: many hot draws, several per bucket."""
    from pyspark.sql import functions as F
    from scrubspark.functions.draws import uniform
    from .conftest import SF_CHECK
    o = spark.read.parquet(f"{SF_CHECK}/orders.parquet").select("o_orderkey")
    k = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 40).otherwise(F.col("o_orderkey"))
    d = o.withColumn("k", k).repartition(5)
    n = d.count()
    out = inject.shuffle_rows(d, "k", rows_per_bucket=50)
    rows = out.withColumn("_u", uniform("k", "shuffle")).orderBy("row_rank").collect()
    assert [r["row_rank"] for r in rows] == list(range(n))
    pairs = [(r["_u"], r["k"]) for r in rows]
    assert pairs == sorted(pairs)
    assert sorted(r["o_orderkey"] for r in rows) == sorted(r[0] for r in o.collect())


def test_sample_is_the_same_by_any_path_and_partitioning(spark):
    """Repeated keys tie on (draw, key); the row hash decides, so both paths pick the same rows."""
    o = spark.range(600).select((F.col("id") % 5).alias("k"), F.col("id").alias("v"))
    want = None
    for parts in (3, 7):
        for limit in (0, 100_000):
            got = sorted(map(tuple, inject.sample_n(o.repartition(parts), 150, "k", topk_limit=limit).collect()))
            want = want or got
            assert got == want and len(got) == 150


@pytest.mark.parametrize("per_bucket", [30, 10_000])
def test_shuffle_ranks_do_not_depend_on_partitions(spark, per_bucket):
    """Rows that tie on (draw, key) are ordered by their own values, in hot keys (small buckets) too; equal rows stay whole."""
    d = spark.range(900).select((F.col("id") % 4).alias("k"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("v"), F.lit(None).cast("int").alias("w"))
    want = None
    for parts in (1, 3, 7):
        got = sorted((r["row_rank"], r["k"], str(r["v"])) for r in inject.shuffle_rows(
            d.repartition(parts, F.rand(parts)), "k", rows_per_bucket=per_bucket).collect())
        want = want or got
        assert [r[0] for r in got] == list(range(900)) and got == want


def test_shuffle_ranks_rows_with_maps(spark):
    d = spark.range(20).select((F.col("id") % 2).alias("k"), F.create_map(F.lit("a"), "id").alias("m"))
    assert sorted(r["row_rank"] for r in inject.shuffle_rows(d, "k", rows_per_bucket=2).collect()) == list(range(20))


def test_sample_is_whole_where_row_hashes_collide(spark, monkeypatch):
    """Unlike rows of one hash are told apart by their text, down to the microsecond; copies keep their number."""
    monkeypatch.setattr(inject, "_row_hash", lambda df: F.lit(1.0))
    t = F.timestamp_micros(F.col("id") % 40).alias("t")
    d = spark.range(120).select(F.lit(1).alias("k"), t, F.struct(t).alias("s"))
    for n in (1, 50, 119):
        got = [sorted(map(str, inject.sample_n(d.repartition(p), n, "k", topk_limit=limit).collect())) for p, limit in ((2, 0), (5, 0), (3, 100_000))]
        assert len(got[0]) == n and got[0] == got[1] == got[2]
        assert sorted(got[0]) == sorted(map(str, d.orderBy("t").limit(n).collect()))
