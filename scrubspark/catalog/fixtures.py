"""Dirty inputs built from the provided tables (FIXTURES.md part B).

The provided tables are clean, so the queries in the catalogue start from
reproducible damage added by ``operators.inject``.  Each builder has a SQL
twin (``*_SQL``) used by the oracle engine; both use the same md5 draws.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubspark.functions.draws import pick, sql_pick, sql_uniform, uniform
from scrubspark.operators import inject
from scrubspark.sources.tables import deal_rows, read_table

# Damage parameters of the test fixtures.
PRICE_OUTLIERS = [-999999, 5000000, 9990000]
QTY_TOKENS = ["N/A", "pending", "---", "HIGH", "??"]
VALUE_OUTLIERS = [-500, 50000]
FLAG_WORDS = ["true", "false", "maybe"]
# The seven action types, in their declared order.
ACTION_TYPES = ["fill_nulls", "remove_duplicates", "fix_dtype", "clip_outliers",
                "rename_column", "drop_column", "done"]
LOG_COLUMNS = ["value", "ts_text", "flag_text"]
LOG_MAX_STEPS = 20
LOG_RUN_EVENTS = 32


def dirty_orders(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    o = read_table(spark, sf_dir, "orders") if orders is None else orders
    o = inject.inject_nulls(o, "o_totalprice", 0.22, "o_orderkey", "price_null")
    o = inject.inject_outliers(o, "o_totalprice", 0.10, PRICE_OUTLIERS, "o_orderkey", "price_out", "price_pick")
    o = inject.inject_nulls(o, "o_orderpriority", 0.12, "o_orderkey", "prio_null")
    o = o.withColumn("qty_text", (F.col("o_custkey") % 20).cast("string"))
    o = inject.inject_tokens(o, "qty_text", 0.18, QTY_TOKENS, "o_orderkey", "qty_tok", "qty_pick")
    o = o.withColumn("admin_note", F.concat(F.lit("note_"), (F.col("o_orderkey") % 1000).cast("string")))
    return inject.inject_duplicates(o, 0.10, "o_orderkey", "dup")


def dirty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    e = inject.inject_nulls(e, "value", 0.25, "event_id", "val_null")
    e = inject.inject_outliers(e, "value", 0.08, VALUE_OUTLIERS, "event_id", "val_out", "val_pick")
    e = e.withColumn("ts_text", F.when(uniform("event_id", "ts_bad") < 0.05, F.lit("not a date"))
                     .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))
    return e.withColumn("flag_text", pick("event_id", "flag", FLAG_WORDS))


def action_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of cleaning actions over all events: a run is a block of
    ``LOG_RUN_EVENTS`` event ids, longer than ``max_steps``, so the operators
    meet late steps and drop them themselves.  A projection: no shuffle.
    """
    e = read_table(spark, sf_dir, "events").select("event_id")
    k = "event_id"
    act = pick(k, "act", ACTION_TYPES)
    return e.select(
        F.floor(F.col(k) / LOG_RUN_EVENTS).cast("bigint").alias("run_id"),
        F.pmod(F.col(k), F.lit(LOG_RUN_EVENTS)).cast("bigint").alias("step"),
        F.col("event_id"),
        act.alias("action_type"),
        F.when(act.isin("remove_duplicates", "done"), F.lit(None).cast("string"))
         .otherwise(pick(k, "col", LOG_COLUMNS)).alias("column"),
        F.round(uniform(k, "conf"), 2).alias("confidence"),
        (uniform(k, "ok") >= 0.1).alias("success"),
        (uniform(k, "noop") < 0.15).alias("noop"),
        F.round(uniform(k, "na") * 0.1, 4).alias("null_after"),
        F.round(uniform(k, "sr") * 0.5, 4).alias("std_reduction"),
        F.round(uniform(k, "grade"), 4).alias("grade"),
        (uniform(k, "rep") >= 0.2).alias("replay_ok"),
        (uniform(k, "can") < 0.5).alias("canonical"),
        (uniform(k, "irr") < 0.5).alias("irrelevant"),
        F.lit(LOG_MAX_STEPS).cast("int").alias("max_steps"),
    )


def raw_replies(spark: SparkSession, sf_dir: str, valid_types: bool = False) -> DataFrame:
    """Model replies as text, four shapes by ``event_id % 4``: plain JSON, a
    fenced block tagged json, JSON inside prose, and text that is not JSON."""
    e = deal_rows(read_table(spark, sf_dir, "events", spread=False)).select("event_id", "event_type")
    atype = pick("event_id", "act", ACTION_TYPES) if valid_types else F.col("event_type")
    body = F.concat(
        F.lit('{"action_type": "'), atype,
        F.lit('", "column": " value ", "params": {"strategy": "median"}, "confidence": '),
        (F.col("event_id") % 3).cast("string"), F.lit('.5, "reasoning": "x"}'))
    e = e.select("event_id", body.alias("body"))
    body, shape = F.col("body"), F.col("event_id") % 4
    raw = (F.when(shape == 0, body)
           .when(shape == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
           .when(shape == 2, F.concat(F.lit("Sure. Here is the action: "), body, F.lit(" Hope it helps.")))
           .otherwise(F.lit("not valid json at all %%")))
    return e.select("event_id", raw.alias("raw"))


# ---------------------------------------------------------------------------
# SQL twins for the oracle engine.

def _u(salt: str, key: str) -> str:
    return sql_uniform(key, salt)


def _p(salt: str, key: str, choices: list) -> str:
    return sql_pick(key, salt, choices)


DIRTY_ORDERS_SQL = f"""
dirty_orders_base AS (
  SELECT o_orderkey, o_custkey, o_orderstatus,
    CASE WHEN {_u('price_null', 'o_orderkey')} < 0.22 THEN NULL
         WHEN {_u('price_out', 'o_orderkey')} < 0.10 THEN CAST({_p('price_pick', 'o_orderkey', PRICE_OUTLIERS)} AS DOUBLE)
         ELSE o_totalprice END AS o_totalprice,
    o_orderdate,
    CASE WHEN {_u('prio_null', 'o_orderkey')} < 0.12 THEN NULL ELSE o_orderpriority END AS o_orderpriority,
    CASE WHEN {_u('qty_tok', 'o_orderkey')} < 0.18 THEN {_p('qty_pick', 'o_orderkey', QTY_TOKENS)}
         ELSE CAST(o_custkey % 20 AS VARCHAR) END AS qty_text,
    'note_' || CAST(o_orderkey % 1000 AS VARCHAR) AS admin_note
  FROM orders),
dirty_orders AS (
  SELECT * FROM dirty_orders_base
  UNION ALL SELECT * FROM dirty_orders_base WHERE {_u('dup', 'o_orderkey')} < 0.10)"""

DIRTY_EVENTS_SQL = f"""
dirty_events AS (
  SELECT event_id, ts, user_id, event_type,
    CASE WHEN {_u('val_null', 'event_id')} < 0.25 THEN NULL
         WHEN {_u('val_out', 'event_id')} < 0.08 THEN CAST({_p('val_pick', 'event_id', VALUE_OUTLIERS)} AS DOUBLE)
         ELSE value END AS value,
    CASE WHEN {_u('ts_bad', 'event_id')} < 0.05 THEN 'not a date'
         ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS ts_text,
    {_p('flag', 'event_id', FLAG_WORDS)} AS flag_text
  FROM events)"""

_ACT = _p('act', 'event_id', ACTION_TYPES)
ACTION_LOG_SQL = f"""
action_log AS (
  SELECT event_id // {LOG_RUN_EVENTS} AS run_id, event_id % {LOG_RUN_EVENTS} AS step, event_id,
    {_ACT} AS action_type,
    CASE WHEN {_ACT} IN ('remove_duplicates', 'done') THEN NULL
         ELSE {_p('col', 'event_id', LOG_COLUMNS)} END AS "column",
    round({_u('conf', 'event_id')}, 2) AS confidence,
    {_u('ok', 'event_id')} >= 0.1 AS success,
    {_u('noop', 'event_id')} < 0.15 AS noop,
    round({_u('na', 'event_id')} * 0.1, 4) AS null_after,
    round({_u('sr', 'event_id')} * 0.5, 4) AS std_reduction,
    round({_u('grade', 'event_id')}, 4) AS grade,
    {_u('rep', 'event_id')} >= 0.2 AS replay_ok,
    {_u('can', 'event_id')} < 0.5 AS canonical,
    {_u('irr', 'event_id')} < 0.5 AS irrelevant,
    CAST({LOG_MAX_STEPS} AS INTEGER) AS max_steps
  FROM events)"""


def raw_replies_sql(valid_types: bool = False) -> str:
    atype = _ACT if valid_types else "event_type"
    body = (f"('{{\"action_type\": \"' || {atype} || '\", \"column\": \" value \", "
            f"\"params\": {{\"strategy\": \"median\"}}, \"confidence\": ' || CAST(event_id % 3 AS VARCHAR) "
            f"|| '.5, \"reasoning\": \"x\"}}')")
    return f"""
raw_replies AS (
  SELECT event_id,
    CASE event_id % 4
      WHEN 0 THEN {body}
      WHEN 1 THEN '```json' || chr(10) || {body} || chr(10) || '```'
      WHEN 2 THEN 'Sure. Here is the action: ' || {body} || ' Hope it helps.'
      ELSE 'not valid json at all %%' END AS raw
  FROM events)"""
