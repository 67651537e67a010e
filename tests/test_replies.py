from pyspark.sql import functions as F

from scrubspark.catalog import fixtures as fx
from scrubspark.catalog.queries import QUERIES
from scrubspark.functions import replies
from tests.conftest import optimized_plan


def test_parse_shapes(spark):
    body = '{"action_type": "fill_nulls", "column": " age ", "params": {"strategy": "median"}, ' \
           '"confidence": 0.8, "reasoning": "x"}'
    rows = [(0, body), (1, "```json\n" + body + "\n```"), (2, "Sure: " + body + " ok"),
            (3, "```\n" + body + "\n```"), (4, "not json"), (5, "  \n" + body + "\n  ")]
    df = spark.createDataFrame(rows, "id int, raw string")
    got = {r["id"]: r for r in replies.parse_actions(df, "raw").collect()}
    for i in (0, 1, 2, 3, 5):
        assert got[i]["parsed"] and got[i]["action"]["action_type"] == "fill_nulls"
        assert got[i]["action"]["params"]["strategy"] == "median"
        assert "reasoning" not in got[i]["action"].asDict()
    assert not got[4]["parsed"]


def test_clamp_and_validate(spark):
    df = spark.createDataFrame([("done", " a ", 1.5), ("bogus", None, 0.2), ("done", None, None)],
                               "action_type string, column string, confidence double")
    c = [r[0] for r in df.select(replies.clamp_confidence("confidence")).collect()]
    assert c == [1.0, 0.2, 0.5]
    v = replies.validate_actions(df).collect()
    assert [r["valid"] for r in v] == [False, False, True]
    assert v[0]["reason"] == "confidence out of range" and v[1]["reason"] == "unknown action_type"
    assert v[0]["column"] == "a" and v[2]["confidence"] == 0.5
    assert F is not None


def test_confidence_given_as_text_counts(spark):
    df = spark.createDataFrame([('{"action_type": "done", "confidence": "0.9"}',), ('{"action_type": "done", "confidence": 0.25}',),
                                ('{"action_type": "done", "confidence": "high"}',), ("no json",)], "raw string")
    out = replies.parse_actions(df, "raw").withColumn("action", replies.action_or_done())
    assert sorted(str(r["action"]["confidence"]) for r in out.collect()) == ["0.25", "0.5", "0.9", "None"]
    clamped = out.select(replies.clamp_confidence("action.confidence").alias("c")).collect()
    assert sorted(r["c"] for r in clamped) == [0.25, 0.5, 0.5, 0.9]


def _events(spark, path, n=3):
    rows = spark.range(0, n, 1, 1).select(F.xxhash64("id").alias("event_id"), F.lit("view").alias("event_type"))
    rows.write.parquet(f"{path}/events.parquet")
    return str(path)


def test_each_reply_is_read_once(spark, tmp_path):
    """Every field comes from one JSON parse, and no pattern is run twice on a reply (F1)."""
    sf = _events(spark, tmp_path)
    for name in ("parse_fallback", "parse_actions", "clamp_confidence"):
        plan = optimized_plan(QUERIES[name](spark, sf))
        assert plan.count("from_json(") == 1, name
        assert plan.count("regexp_replace(") <= 2 and plan.count("regexp_extract(") <= 1, name


def test_odd_replies_keep_their_rows(spark):
    body = '{"action_type": "done", "column": "a", "confidence": 0.5}'
    texts = [None, "", "```", "``````", "```json", "```JSON" + body, "````" + body, "``` x\n" + body + "``` " + body, body + body,
             "[" + body + "]", "}" + body + "{", '{"action_type": {"a": 1}, "params": "no map", "confidence": " 1e-1 "}',
             '{"params": {"strategy": null}, "action_type": null}', '{"action_type": "done", "params": ""}', '{"action_type": "do']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, raw string")
    got = {r["id"]: r["action"]["action_type"] if r["action"] else None for r in replies.parse_actions(df, "raw").collect()}
    assert len(got) == len(texts)
    assert [i for i in got if got[i] is not None] == [5, 6, 7, 8, 9, 10, 11, 13]
    assert got[11] == '{"a":1}' and got[13] == "done"


def test_replies_of_one_row_group_reach_all_tasks(spark, tmp_path):
    """A table in one row group is read by one split, however many there are: its rows are dealt anew (F2)."""
    sf, key = _events(spark, tmp_path, 200000), "spark.sql.files.maxPartitionBytes"
    spark.conf.set(key, "256k")
    try:
        raw = fx.raw_replies(spark, sf)
        sizes = [r["count"] for r in raw.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.unset(key)
    assert sum(sizes) == 200000 and len(sizes) >= 4 and max(sizes) <= 60000


def test_validated_replies_draw_their_action_once(spark, tmp_path):
    """The drawn action type and the reply around it are built once, and read as JSON once."""
    plan = optimized_plan(QUERIES["validate_actions"](spark, _events(spark, tmp_path)))
    assert plan.count("md5(") == 1 and plan.count("from_json(") == 1
