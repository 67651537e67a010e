import math

import pytest
from pyspark.sql import functions as F

from scrubspark.functions.numeric import parse_number

CASES = {
    "5": 5.0, " 5 ": 5.0, "1e5": 1e5, "+3": 3.0, ".5": 0.5, "5.": 5.0,
    "1.0d": None, "1f": None, "1_000": None, "nan": None, "NaN": None,
    "inf": math.inf, "-Infinity": -math.inf,
    "N/A": None, "": None, "1,000": None, "0x10": None, "true": None,
}


def test_text_to_number_rule(spark):
    df = spark.createDataFrame([(k,) for k in CASES], "s string")
    got = {r["s"]: r["x"] for r in df.select("s", parse_number(F.col("s")).alias("x")).collect()}
    for text, want in CASES.items():
        assert got[text] == want, text


def test_numeric_columns_are_only_cast(spark):
    df = spark.createDataFrame([(1,), (None,)], "a bigint")
    got = [r[0] for r in df.select(parse_number(F.col("a"), df.schema["a"].dataType)).collect()]
    assert got == [1.0, None]


@pytest.mark.parametrize("text", ["nan", "abc", "--1"])
def test_non_numbers_are_null(spark, text):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(parse_number(F.col("s"))).first()[0] is None
