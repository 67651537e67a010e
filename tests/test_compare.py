import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from scrubspark.functions.refusals import Refusal
from scrubspark.plans import compare

SCHEMA = "k long, a int, b string, c double"


def plain(left, right):
    by = defaultdict(lambda: ([], []))
    for side, rows in enumerate((left, right)):
        for r in rows:
            by[r[0]][side].append(r[1:])
    out = []
    for k, (x, y) in by.items():
        cols = [n for i, n in enumerate("abc") if sorted(map(str, (r[i] for r in x))) != sorted(map(str, (r[i] for r in y)))]
        if cols or len(x) != len(y):
            out.append(str((k, len(x), len(y), "added" if not x else "removed" if not y else "changed", cols)))
    return sorted(out)


@pytest.mark.parametrize("fanout,most_open", [(2, 1000), (64, 1000), (8, 3)])
def test_differences_equal_plain_comparison(spark, fanout, most_open):
    rnd = random.Random(fanout)
    left = [(rnd.choice([None, -5, 1 << 40, *range(0, 900)]), rnd.randint(0, 2) or None, rnd.choice("xyz"), rnd.random()) for _ in range(700)]
    right = [r if rnd.random() > 0.02 else (r[0], r[1], rnd.choice(["x", None]), r[2] and 0.5) for r in left if rnd.random() > 0.01]
    right += [(10_000 + i, 1, "n", 0.0) for i in range(3)]
    a, b = (spark.createDataFrame(x, SCHEMA).repartition(n) for x, n in ((left, 3), (right, 4)))
    got = compare.differences(a, b, "k", fanout, most_open).collect()
    assert sorted(str((r["k"], r["left_rows"], r["right_rows"], r["change"], r["columns"])) for r in got) == plain(left, right)


def test_one_changed_cell_is_narrowed_to_its_key(spark, capsys):
    left = spark.range(100_000).select(F.col("id").alias("k"), (F.col("id") % 7).cast("int").alias("a"), F.lit("x").alias("b"), (F.col("id") / 3).alias("c"))
    right = left.withColumn("c", F.when(F.col("k") == 77_123, F.col("c") + 1e-9).otherwise(F.col("c"))).repartition(5)
    assert [tuple(r) for r in compare.differing_ranges(left, right, "k").collect()] == [(77_123, 77_123)]
    (r,) = compare.differences(left, right, "k").collect()
    assert (r["k"], r["change"], r["columns"]) == (77_123, "changed", ["c"])
    # Cells that change places between rows of one range are a difference too.
    swapped = left.withColumn("a", F.when(F.col("k") == 1, 2).when(F.col("k") == 2, 1).otherwise(F.col("a")).cast("int"))
    assert [r["k"] for r in compare.differences(left, swapped, "k").orderBy("k").collect()] == [1, 2]


def test_equal_empty_and_unlike_tables(spark):
    left = spark.createDataFrame([(1, 1, "x", 0.0), (1, 1, "x", 0.0), (None, 2, "y", None)], SCHEMA)
    none = left.limit(0)
    assert compare.differences(left, left.repartition(2), "k").count() == 0 and compare.differences(none, none, "k").count() == 0
    got = {r["k"]: (r["left_rows"], r["right_rows"], r["change"]) for r in compare.differences(none, left, "k").collect()}
    assert got == {1: (0, 2, "added"), None: (0, 1, "added")}
    with pytest.raises(Refusal):
        compare.differences(left, left, "b")
    with pytest.raises(Refusal):
        compare.differences(left, left.drop("a"), "k")
