import csv
import math
import random

import pytest
from pyspark.sql import functions as F

from scrubspark.sources import csv_records, tables


def _csv(tmp_path, text):
    path = tmp_path / "in.csv"
    path.write_text(text)
    return str(path)


def test_types_of_an_uploaded_csv(spark, tmp_path):
    path = _csv(tmp_path, 'id,long_id,flag,x,note,gap\n'
                          '1,12345678901234567890,True,inf,"two\nlines, ""quoted""",\n'
                          '2,12345678901234567891,False,-1.5,plain,\n'
                          'N/A,7,,1e3,NULL,\n')
    df = tables.read_csv(spark, path)
    assert dict(df.dtypes) == {"id": "bigint", "long_id": "string", "flag": "boolean", "x": "double",
                               "note": "string", "gap": "string"}
    rows = df.orderBy(F.col("id").asc_nulls_last()).collect()
    assert [r["id"] for r in rows] == [1, 2, None]
    assert [r["long_id"] for r in rows] == ["12345678901234567890", "12345678901234567891", "7"]
    assert [r["flag"] for r in rows] == [True, False, None]
    assert rows[0]["note"] == 'two\nlines, "quoted"' and rows[2]["note"] is None
    assert math.isinf(rows[0]["x"]) and [r["x"] for r in rows[1:]] == [-1.5, 1000.0]


def test_csv_round_trip_keeps_text(spark, tmp_path):
    texts = ["a\nb", ' "x" ', "c,d", "back\\slash", "tail \\"]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string")
    tables.write_csv(df, str(tmp_path / "out"))
    got = {r["id"]: r["t"] for r in tables.read_csv(spark, str(tmp_path / "out")).collect()}
    assert got == dict(enumerate(texts))


def test_csv_without_rows(spark, tmp_path):
    df = tables.read_csv(spark, _csv(tmp_path, "a,b\n"))
    assert df.columns == ["a", "b"] and df.count() == 0


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda n: [spark.conf.set(k, str(v)) for k, v in zip(old, (n, 0))]
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("size", [7, 40, 333, 100_000])
def test_records_do_not_depend_on_the_byte_ranges(spark, tmp_path, small_splits, size):
    """Quoted line breaks, doubled quotes, empty lines and fields, CRLF and letters of several bytes, over split borders."""
    rnd = random.Random(size)
    cells = ["plain", "", "two\nlines", "a\n\n\nb", 'say ""hi""\n""', "ünï\ncödé", ",", "x" * 50, '""', "\n", "1.5"]
    for k in range(3):
        rows = ['"' + rnd.choice(cells) + '",' + rnd.choice(['"q"', "u", "", '"' + rnd.choice(cells) + '"']) + f",{i}" for i in range(60)]
        end = "\r\n" if k == 1 else "\n"
        text = '"first\nname",b,k' + end + end.join(rows) + ("" if k == 2 else end + end)
        (tmp_path / f"in{k}.csv").write_bytes(text.encode())
    path = str(tmp_path / "in*.csv")
    want = []
    for k in range(3):
        with open(tmp_path / f"in{k}.csv", newline="") as f:
            want += [str(tuple(c or None for c in row)) for row in list(csv.reader(f))[1:] if row]
    small_splits(size)
    raw = csv_records.read_text_columns(spark, path)
    got, want = sorted(str(tuple(r)) for r in raw.collect()), sorted(want)
    assert got == want and len(got) == 180 and raw.columns == ["first\nname", "b", "k"]


def test_one_large_file_is_read_by_many_tasks(spark, tmp_path, small_splits):
    path = _csv(tmp_path, "a,b\n" + "".join(f'"line {i}\nof ""{i}""",{i}\n' for i in range(3000)))
    small_splits(4096)
    assert spark.read.text(path).rdd.getNumPartitions() > 5
    df = tables.read_csv(spark, path)
    assert df.count() == 3000 and df.where("a = concat('line ', b, '\n', 'of \"', b, '\"')").count() == 3000
    assert dict(df.dtypes) == {"a": "string", "b": "bigint"}


def test_an_unclosed_quote_takes_the_rest_of_its_file(spark, tmp_path, small_splits):
    path = _csv(tmp_path, 'a,b\n1,2\n"open,3\n4,5\n')
    small_splits(5)
    assert [r["a"] for r in csv_records.read_text_columns(spark, path).orderBy("a").collect()][0] == "1"
    assert csv_records.records(spark, path).count() == 3
