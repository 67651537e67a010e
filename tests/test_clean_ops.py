import pytest
from pyspark.sql import functions as F

from scrubspark.operators import clip, columns, dedup, dtype, fill

from .conftest import SF_CHECK, SF_SMALL, plan_text


def test_fill_strategies(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0), (4, 3.0), (5, None)], "id bigint, x double")
    val = lambda d: [r["x"] for r in d.orderBy("id").collect()]
    assert val(fill.fill_nulls(df, "x", "mean")) == [1.0, 7 / 3, 3.0, 3.0, 7 / 3]
    assert val(fill.fill_nulls(df, "x", "median")) == [1.0, 3.0, 3.0, 3.0, 3.0]
    assert val(fill.fill_nulls(df, "x", "mode")) == [1.0, 3.0, 3.0, 3.0, 3.0]
    assert val(fill.fill_nulls(df, "x", "constant")) == [1.0, 0.0, 3.0, 3.0, 0.0]
    assert val(fill.fill_nulls(df, "x", "constant", 9)) == [1.0, 9.0, 3.0, 3.0, 9.0]


def test_fill_mode_of_text_column(spark):
    df = spark.createDataFrame([("b",), ("b",), ("a",), ("a",), (None,)], "x string")
    assert [r[0] for r in fill.fill_nulls(df, "x", "mode").collect()].count("a") == 3


def test_fill_all_null_column_has_no_value(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    with pytest.raises(ValueError):
        fill.fill_nulls(df, "x", "mean")


def test_mean_of_text_is_an_error(spark):
    df = spark.createDataFrame([("a",)], "x string")
    with pytest.raises(ValueError):
        fill.fill_nulls(df, "x", "median")


def test_forward_fill_edges(spark):
    rows = [(None, 1, None), (1, 1, None), (2, 1, 5.0), (3, 1, None),   # leading null, carry inside a bucket
            (10, 2, None), (11, 2, None),                               # a whole bucket of nulls
            (20, 3, None), (21, 3, 7.0), (22, 3, None)]
    df = spark.createDataFrame(rows, "k bigint, b bigint, x double")
    out = fill.forward_fill(df, "x", ["k"], bucket=F.col("b"), split_hot=False)
    got = {r["k"]: r["x"] for r in out.collect()}
    assert got == {r["k"]: r["x"] for r in fill.forward_fill(df, "x", ["k"]).collect()}
    assert got == {None: None, 1: None, 2: 5.0, 3: 5.0, 10: 5.0, 11: 5.0, 20: 5.0, 21: 7.0, 22: 7.0}
    assert _brute_ffill(df, "x", ["k"], "k") == got


def _brute_ffill(df, col, order_by, key):
    """Forward fill in plain Python over the collected (small) fixture: the
    reference result for the distributed operator.  NULL order keys sort first."""
    rows = sorted(df.collect(), key=lambda r: tuple((r[o] is not None, r[o]) for o in order_by))
    out, last = {}, None
    for r in rows:
        last = r[col] if r[col] is not None else last
        out[r[key]] = last
    return out


def test_bucketed_forward_fill_equals_global_on_events(spark):
    from scrubspark.catalog import fixtures as fx
    e = fx.dirty_events(spark, SF_CHECK)
    a = fill.forward_fill(e, "value", ["ts", "event_id"], bucket=F.date_trunc("day", "ts"), split_hot=False)
    got = {r["event_id"]: r["value"] for r in a.select("event_id", "value").collect()}
    assert got == _brute_ffill(e, "value", ["ts", "event_id"], "event_id")


def _in_total_order(df, col, order_by):
    """Expected rows: a plain walk over the collected rows in the documented order (row hash last)."""
    rows = df.withColumn("_h", fill.total_order(df, col, order_by)[-1]).collect()
    rows.sort(key=lambda r: (*[(r[o] is not None, r[o] if r[o] is not None else 0) for o in order_by],
                             r[col] is not None, r["_h"]))
    out, last = [], None
    for r in rows:
        last = r[col] if r[col] is not None else last
        out.append(tuple(last if c == col else r[c] for c in df.columns))
    return sorted(out, key=repr)


def _filled(df, col, order_by, n):
    return sorted(map(tuple, fill.forward_fill(df, col, order_by, n_buckets=n).collect()), key=repr)


def _range_sizes(df, col, order_by, n):
    t = fill.order_ranges(df, fill.total_order(df, col, order_by), n)
    return [r["count"] for r in t.groupBy("__b").count().collect()]


@pytest.fixture(scope="module")
def events(spark):
    from scrubspark.catalog import fixtures as fx
    return fx.dirty_events(spark, SF_CHECK).select("event_id", "ts", "value").cache()


def test_ranges_fill_like_a_global_walk(spark, events):
    got = {r["event_id"]: r["value"] for r in fill.forward_fill(events, "value", ["ts", "event_id"], n_buckets=23).collect()}
    assert got == _brute_ffill(events, "value", ["ts", "event_id"], "event_id")


def _keyed(e, name):
    """(table, order columns): hot, tied, text and several order keys."""
    i = F.col("event_id")
    if name == "hot and null":
        k = F.when(i % 3 == 0, F.lit(-5)).when(i % 5 == 1, F.lit(None)).otherwise(i).cast("bigint")
        return e.select("event_id", k.alias("k"), "value"), ["k"]
    if name == "fifty hot":
        return e.select("event_id", F.when(i % 5 != 0, i % 50).otherwise(i + 1000).alias("k"), "value"), ["k"]
    if name == "copies":
        same = e.select(F.lit(7).cast("bigint").alias("event_id"), F.lit(1).alias("k"), F.lit(None).cast("double").alias("value"))
        return e.select("event_id", (i % 3).cast("int").alias("k"), "value").unionByName(same), ["k"]
    if name == "text":
        return e.select("event_id", F.concat(F.lit("ORD-00"), F.lpad(i.cast("string"), 8, "0")).alias("k"), "value"), ["k"]
    if name == "past 2^53":
        return e.select("event_id", (F.lit(2 ** 60) + i).alias("k"), "value"), ["k"]
    return e.select("event_id", F.lit(1).alias("a"), F.lit("x").alias("b"), (i % 40).alias("k"), "value"), ["a", "b", "k"]


@pytest.mark.parametrize("name", ["hot and null", "fifty hot", "copies", "text", "past 2^53", "three columns"])
def test_fill_is_the_same_for_any_ranges_and_partitions(spark, events, name):
    df, order = _keyed(events, name)
    want = _in_total_order(df, "value", order)
    for n, parts in ((1, 3), (4, 7), (64, 3)):
        assert _filled(df.repartition(parts), "value", order, n) == want
    sizes = _range_sizes(df, "value", order, 16)
    assert len(sizes) == 16 and max(sizes) < 4 * sum(sizes) / 16


def test_carry_table_is_broadcast(spark, events):
    """One row per range, a proven size: the join back moves only the carry table."""
    out = fill.forward_fill(events, "value", ["ts", "event_id"], n_buckets=16)
    out.write.format("noop").mode("overwrite").save()
    plan = plan_text(out)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_forward_fill_big_side_never_single_partition(spark, events):
    for kw in ({"n_buckets": 16}, {"bucket": F.date_trunc("day", "ts"), "split_hot": False}):
        out = fill.forward_fill(events, "value", ["ts", "event_id"], **kw)
        out.write.format("noop").mode("overwrite").save()
        plan = plan_text(out)
        # the only single-partition exchange is the carry table
        assert plan.count("SinglePartition") <= 1
        assert "hashpartitioning(__b" in plan


def test_dedup_all_and_idempotent(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 3.0), (2, 3.0), (2, 4.0)], "a bigint, b double")
    once = dedup.remove_duplicates(df)
    assert once.count() == 3
    assert dedup.remove_duplicates(once).count() == 3


def test_dedup_null_and_nan_rows(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, float("nan")), (1, float("nan"))], "a bigint, b double")
    assert dedup.remove_duplicates(df).count() == 2


def test_subset_dedup_keeps_first_by_order(spark):
    df = spark.createDataFrame([(3, "x", "c"), (1, "x", "a"), (2, "y", "b"), (5, "y", "e")],
                               "k bigint, g string, v string")
    out = {r["g"]: r["v"] for r in dedup.remove_duplicates(df, ["g"], ["k"]).collect()}
    assert out == {"x": "a", "y": "b"}
    with pytest.raises(ValueError):
        dedup.remove_duplicates(df, ["nope"], ["k"])


def test_subset_dedup_limits_rows_before_shuffle(spark):
    df = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    out = dedup.remove_duplicates(df, ["text"], ["doc_id"])
    out.write.format("noop").mode("overwrite").save()
    assert "WindowGroupLimit" in plan_text(out)


def test_duplicate_rate(spark):
    df = spark.createDataFrame([(1,)] * 50 + [(2,)] * 50, "a bigint")
    assert dedup.duplicate_rate(df) == pytest.approx(0.98)


def test_fix_dtype_int_fails_on_fraction(spark):
    df = spark.createDataFrame([("1",), ("2.5",)], "x string")
    with pytest.raises(ValueError):
        dtype.fix_dtype(df, "x", "int64")
    ok = spark.createDataFrame([("1",), ("2.0",), ("N/A",)], "x string")
    assert [r[0] for r in dtype.fix_dtype(ok, "x", "int").collect()] == [1, 2, None]


def test_fix_dtype_other_targets(spark):
    df = spark.createDataFrame([("2024-01-02 03:04:05", "true", 7)], "t string, b string, n bigint")
    out = dtype.fix_dtype(dtype.fix_dtype(dtype.fix_dtype(df, "t", "datetime64"), "b", "bool"), "n", "str")
    assert [f.dataType.simpleString() for f in out.schema.fields] == ["timestamp_ntz", "boolean", "string"]
    with pytest.raises(ValueError):
        dtype.fix_dtype(df, "n", "complex128")


def test_clip_keeps_nulls_and_is_idempotent(spark):
    rows = [(float(i),) for i in range(100)] + [(1000.0,), (None,)]
    df = spark.createDataFrame(rows, "x double")
    once = clip.clip_outliers(df, "x", "iqr")
    vals = [r[0] for r in once.collect()]
    assert None in vals and max(v for v in vals if v is not None) < 1000.0
    twice = clip.clip_outliers(once, "x", "iqr")
    assert sorted(v for v in [r[0] for r in twice.collect()] if v is not None) == \
        sorted(v for v in vals if v is not None)


def test_clip_methods_and_errors(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)] + [("text",) and (None,)], "x double")
    lo, hi = clip.fit_clip_bounds(df, "x", "percentile", lower_pct=10, upper_pct=90)
    assert (lo, hi) == (10.0, 90.0)
    lo, hi = clip.fit_clip_bounds(df, "x", "zscore", threshold=1.0)
    assert lo == pytest.approx(50 - 29.300170647967224) and hi == pytest.approx(50 + 29.300170647967224)
    txt = spark.createDataFrame([("a",)], "s string")
    with pytest.raises(ValueError):
        clip.clip_outliers(txt, "s")
    with pytest.raises(ValueError):
        clip.clip_outliers(df, "x", "wavelet")


def test_rename_and_drop_errors(spark):
    df = spark.createDataFrame([(1, 2)], "a bigint, b bigint")
    with pytest.raises(ValueError):
        columns.rename_column(df, "a", "b")
    with pytest.raises(ValueError):
        columns.drop_column(df, "zzz")
    assert columns.rename_column(df, "a", "c").columns == ["c", "b"]
    assert columns.is_canonical("quantity", {"qty": "quantity"})


def test_fill_transform_is_a_projection(spark):
    df = spark.read.parquet(f"{SF_CHECK}/events.parquet")
    out = fill.fill_nulls(df, "value", "median").where(F.col("event_id") < 100).select("event_id", "value")
    plan = plan_text(out)
    assert "Join" not in plan and "PushedFilters: [IsNotNull(event_id), LessThan(event_id,100)]" in plan


def _distinct(df):
    return len({str(r) for r in df.collect()})


def test_distinct_rows_are_exact_when_fingerprints_collide(spark, monkeypatch):
    from scrubspark.operators import dedup
    rows = [(i % 7, None if i % 3 else "x", float(i % 2)) for i in range(60)] + [(None, None, None), (None, None, float("nan")), (0, "x", -0.0)] * 2
    df = spark.createDataFrame(rows, "a int, b string, c double").repartition(4)
    want = dedup.duplicate_counts(df)
    assert want[0] == len(rows)
    monkeypatch.setattr(dedup, "WHOLE_ROW_BYTES", -1)
    assert dedup.duplicate_counts(df) == want and dedup.duplicate_counts(df, ["a"])[1] == 8
    # Hashes of two bits: most fingerprints are shared by different rows.
    monkeypatch.setattr(dedup, "cell_hash", lambda name, place, half: f"pmod(xxhash64({half}, {place}, `{name}`), 4)")
    assert dedup.duplicate_counts(df) == want and dedup.duplicate_counts(df.limit(0)) == (0, 0)


def test_row_counts_follow_changes_of_single_columns(spark):
    from scrubspark.operators import dedup
    df = spark.createDataFrame([(i % 4, i % 3 if i % 5 else None, "ab"[i % 2]) for i in range(50)], "a int, b int, `c d` string").repartition(3)
    counts = dedup.RowCounts(df, df.columns, {"rows": 50, "distinct": _distinct(df)})
    steps = [("b", F.coalesce("b", F.lit(1))), ("a", F.when(F.col("a") > 1, 1).otherwise(F.col("a"))), ("c d", F.lit("z")),
             ("a", F.col("a")), ("b", F.when(F.col("b") == 1, None).otherwise(F.col("b"))), ("a", F.col("a") * 100)]
    for column, expr in steps:
        new = df.withColumn(column, expr)
        got = counts.change(df, column, lambda d: d.withColumn(column, expr))
        assert got == _distinct(new) == counts.distinct
        df = new
    counts.close()


def test_header_and_quality_plans_carry_no_whole_row(spark, capsys):
    from scrubspark.catalog import fixtures as fx
    from scrubspark.operators import dedup, stats
    d = fx.dirty_orders(spark, SF_SMALL)
    with dedup.held(dedup.fingerprint_groups(d, d.columns)) as groups:
        stats.side_by_side(d.agg(F.count(F.lit(1)).alias("n")), dedup.group_totals(groups)).explain("formatted")
    plan = capsys.readouterr().out
    assert "Expand" not in plan and "struct(" not in plan
