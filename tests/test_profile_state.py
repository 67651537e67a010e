import math
import os
import random

import pytest
from pyspark.sql import functions as F

from scrubspark.functions.refusals import Refusal
from scrubspark.operators import profile, profile_state

SCHEMA = "few int, many double, note string, num_text string, raw binary, empty double"
FIGURES = ("ordinal", "name", "dtype", "is_numeric", "is_text", "n_rows", "n_values", "null_rate", "min", "max", "parse_rate", "flags")


def rows(n, seed):
    rnd = random.Random(seed)
    return [(rnd.choice([None, 1, 2, 2, 2, 90]), rnd.choice([None, math.nan, rnd.gauss(1e6, 1.0), rnd.gauss(0, 1e-3), -0.0, 0.0]),
             rnd.choice(["a", "", "NULL", None, "ü" * 2000]), rnd.choice(["1", " 2 ", "x", None]), rnd.choice([None, b"\xff", b"\xfe"]), None)
            for _ in range(n)]


def same(got, full, exact=("n_unique", "q1", "q3", "outlier_frac")):
    assert [{k: d[k] for k in FIGURES} for d in got] == [{k: d[k] for k in FIGURES} for d in full]
    for a, b in zip(got, full):
        for k in ("mean", "std"):
            assert a[k] is b[k] is None or math.isclose(a[k], b[k], rel_tol=1e-9)
        if a["exact"]:
            assert [a[k] for k in exact] == [b[k] for k in exact], a["name"]


def put(spark, data, where, n=2):
    spark.createDataFrame(data, SCHEMA).repartition(n).write.mode("append").parquet(where)


def test_profile_after_appends_equals_the_full_profile(spark, tmp_path):
    data, state = str(tmp_path / "data"), str(tmp_path / "state")
    covered = set()
    for seed, n in enumerate((400, 1, 0, 700)):
        put(spark, rows(n, seed), data)
        read = profile_state.update(spark, state, data)
        on_disk = {f for f in os.listdir(data) if f.endswith(".parquet")}
        assert {os.path.basename(p) for p in read} == on_disk - covered
        covered = on_disk
        got, head = profile_state.stored_profile(spark, state)
        full, want = profile.fit_profile_and_header(spark.read.parquet(data), samples=0)
        same(got, full)
        assert all(d["exact"] == ["n_unique", "quartiles", "outlier_frac"] for d in got)
        assert (head["n_rows"], head["n_cols"]) == (want["n_rows"], want["n_cols"])
        assert abs(head["n_distinct"] - want["n_distinct"]) <= 0.1 * want["n_distinct"]
    assert profile_state.update(spark, state, data) == []
    assert profile_state.frame(spark, got).count() == 6


def test_only_new_files_are_read(spark, tmp_path):
    data, state = tmp_path / "data", str(tmp_path / "state")
    put(spark, rows(50, 1), str(data), 1)
    profile_state.update(spark, state, str(data))
    (old,) = [f for f in os.listdir(data) if f.endswith(".parquet")]
    times, size = os.stat(data / old), os.path.getsize(data / old)
    want = profile.fit_profile(spark.read.parquet(str(data)), samples=0)
    # Bytes that no reader accepts, with the size and time of the covered file.
    (data / old).write_bytes(b"\0" * size)
    (data / f".{old}.crc").unlink()
    os.utime(data / old, ns=(times.st_atime_ns, times.st_mtime_ns))
    put(spark, rows(0, 1), str(data), 1)
    assert len(profile_state.update(spark, state, str(data))) == 1
    same(profile_state.stored_profile(spark, state)[0], want)
    (data / old).write_bytes(b"\0" * (size + 1))
    with pytest.raises(Refusal, match="covered_file_changed"):
        profile_state.update(spark, state, str(data))


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1)])
def test_columns_past_the_limit_use_sketches_in_any_order(spark, tmp_path, order):
    data, state = str(tmp_path / "data"), str(tmp_path / "state")
    t = spark.range(30_000).select((F.col("id") % 40).alias("few"), F.when(F.col("id") % 500 == 0, 1e9).otherwise(
        F.pmod(F.xxhash64("id"), F.lit(20_000)) / 7).alias("many"), F.lit("x").alias("note"))
    for k in order:
        t.where(F.col("few") % 3 == k).write.mode("append").parquet(data)
        profile_state.update(spark, state, data, keep=100)
    got = {d["name"]: d for d in profile_state.stored_profile(spark, state)[0]}
    full = {d["name"]: d for d in profile.fit_profile(t, samples=0)}
    assert {n: bool(d["exact"]) for n, d in got.items()} == {"few": True, "many": False, "note": True}
    for n in ("few", "note"):
        same([got[n]], [full[n]])
    a, b = got["many"], full["many"]
    assert (a["n_values"], a["min"], a["max"]) == (b["n_values"], b["min"], b["max"])
    assert math.isclose(a["mean"], b["mean"], rel_tol=1e-12) and math.isclose(a["std"], b["std"], rel_tol=1e-12)
    assert abs(a["n_unique"] - b["n_unique"]) < 0.08 * b["n_unique"]
    assert abs(a["q1"] - b["q1"]) < 20 and abs(a["q3"] - b["q3"]) < 20 and abs(a["outlier_frac"] - b["outlier_frac"]) < 0.002


def test_infinities_other_columns_and_no_state(spark, tmp_path):
    data, state = str(tmp_path / "data"), str(tmp_path / "state")
    with pytest.raises(Refusal, match="no_state"):
        profile_state.stored_profile(spark, state)
    for v in (1.0, math.inf, 2.0):
        spark.createDataFrame([(v,), (v,)], "x double").write.mode("append").parquet(data)
        profile_state.update(spark, state, data)
    (d,), head = profile_state.stored_profile(spark, state)
    assert d["mean"] == math.inf and math.isnan(d["std"]) and (d["min"], d["max"], d["n_unique"]) == (1.0, math.inf, 3)
    assert (head["n_distinct"], head["duplicate_rate"]) == (3, 0.5)
    spark.createDataFrame([(1.0, 2)], "x double, y int").write.mode("append").parquet(data)
    with pytest.raises(Refusal, match="unlike_columns"):
        profile_state.update(spark, state, data)
    assert profile_state.stored_profile(spark, state)[1]["n_rows"] == 6
