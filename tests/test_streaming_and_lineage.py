import uuid

from pyspark.sql import functions as F

from scrubspark.catalog import fixtures as fx
from scrubspark.operators import profile as P
from scrubspark.operators import quality as Q
from scrubspark.plans.actions import Action
from scrubspark.plans.clean import clean
from scrubspark.session import checkpoint_dir
from scrubspark.streaming import clean_stream

from .conftest import SF_SMALL


def test_clean_with_checkpoint_cuts_lineage(spark):
    d = fx.dirty_orders(spark, SF_SMALL)
    plan = [Action("remove_duplicates"), Action("fill_nulls", "o_totalprice", {"strategy": "median"})]
    a, _ = clean(d, plan, checkpoint=True)
    b, _ = clean(d, plan)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    # the checkpointed plan reads a checkpoint, not the parquet file
    assert "parquet" not in a._jdf.queryExecution().optimizedPlan().toString().lower()


def test_checkpoint_dir_is_read_from_the_session(spark):
    assert checkpoint_dir(spark) == spark.sparkContext.getCheckpointDir()


def test_fitted_plan_applies_to_a_stream(spark):
    batch = fx.dirty_events(spark, SF_SMALL)
    fitted = clean_stream.fit_plan(batch, [("fill", "value", "median"), ("clip", "value", "iqr")])
    assert fitted[0][0] == "fill" and fitted[1][0] == "clip"
    schema = spark.read.parquet(f"{SF_SMALL}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(SF_SMALL)
    out = clean_stream.apply_plan(stream.select("event_id", "value"), fitted)
    name = "t_" + uuid.uuid4().hex[:8]
    res = clean_stream.run_to_files(out, f"{checkpoint_dir(spark)}/o-{name}", f"{checkpoint_dir(spark)}/t-{name}")
    assert res.count() == batch.count()
    assert res.where(F.col("value").isNull()).count() == 0


def test_stream_dedup_within_watermark(spark):
    schema = spark.read.parquet(f"{SF_SMALL}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(SF_SMALL)
    doubled = stream.select("event_id", "ts").unionByName(stream.select("event_id", "ts"))
    out = clean_stream.dedup_stream(doubled, "ts", "1 hour", ["event_id"])
    name = "d_" + uuid.uuid4().hex[:8]
    res = clean_stream.run_to_files(out, f"{checkpoint_dir(spark)}/o-{name}", f"{checkpoint_dir(spark)}/t-{name}")
    n = spark.read.parquet(f"{SF_SMALL}/events.parquet").count()
    assert res.count() == n


def test_header_lines(spark):
    d = fx.dirty_orders(spark, SF_SMALL)
    h = P.table_header(d)
    lines = [r["line"] for r in P.header_lines(h, Q.quality_scores(P.profile(d), h)).orderBy("line_no").collect()]
    assert lines[0].startswith("Rows: ") and "| Cols: 8 |" in lines[0]
    assert lines[1].startswith("Quality: overall=")
