"""Oracle SQL for the query catalogue (DuckDB dialect), one string per query."""

from __future__ import annotations

from scrubspark.catalog import fixtures as fx
from scrubspark.functions.draws import sql_uniform
from scrubspark.functions.numeric import sql_parse_number
from scrubspark.operators.profile_state import KEEP

ORACLE: dict[str, str] = {}

DO = "WITH " + fx.DIRTY_ORDERS_SQL + "\n"
DE = "WITH " + fx.DIRTY_EVENTS_SQL + "\n"


def _synth_normal(name, mean, sd):
    u1 = f"greatest({sql_uniform('o_orderkey', name + ':a')}, 1.0 / 4294967296.0)"
    u2 = sql_uniform('o_orderkey', name + ':b')
    return f"({mean} + {sd} * sqrt(-2.0 * ln({u1})) * cos(2.0 * 3.141592653589793 * {u2}))"


ORACLE.update({
    "inject_nulls": f"""SELECT event_id, CASE WHEN {sql_uniform('event_id', 'val_null')} < 0.25 THEN NULL
        ELSE value END AS value FROM events""",
    "inject_outliers": f"""SELECT event_id, CASE WHEN value IS NOT NULL AND {sql_uniform('event_id', 'val_out')} < 0.08
        THEN CAST({fx._p('val_pick', 'event_id', fx.VALUE_OUTLIERS)} AS DOUBLE) ELSE value END AS value FROM events""",
    "inject_tokens": f"""SELECT o_orderkey, CASE WHEN {sql_uniform('o_orderkey', 'qty_tok')} < 0.18
        THEN {fx._p('qty_pick', 'o_orderkey', fx.QTY_TOKENS)} ELSE CAST(o_custkey % 20 AS VARCHAR) END AS qty_text
        FROM orders""",
    "as_text": f"""WITH x AS (SELECT l_orderkey, l_linenumber,
          CASE WHEN {sql_uniform("concat_ws('-', l_orderkey, l_linenumber)", 'qty_null')} < 0.10 THEN NULL
          ELSE l_quantity END AS q FROM lineitem)
        SELECT l_orderkey, l_linenumber,
          coalesce(CASE WHEN q = floor(q) THEN CAST(CAST(floor(q) AS BIGINT) AS VARCHAR) ELSE CAST(q AS VARCHAR) END,
                   'N/A') AS l_quantity FROM x""",
    "inject_duplicates": f"""SELECT o_orderkey, o_custkey FROM orders
        UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE {sql_uniform('o_orderkey', 'dup')} < 0.10""",
    "sample_n": f"""SELECT o_orderkey, o_totalprice FROM orders
        ORDER BY {sql_uniform('o_orderkey', 'sample')}, o_orderkey LIMIT 1000""",
    "sample_n_cut": f"""SELECT o_orderkey, o_totalprice FROM orders
        ORDER BY {sql_uniform('o_orderkey', 'sample')}, o_orderkey LIMIT 1000""",
    "shuffle_rows": f"""SELECT o_orderkey,
        CAST(row_number() OVER (ORDER BY {sql_uniform('o_orderkey', 'shuffle')}, o_orderkey) - 1 AS BIGINT) AS row_rank
        FROM orders""",
    "synth_columns": f"""SELECT o_orderkey,
        CAST(1 + floor({sql_uniform('o_orderkey', 'shelf')} * 39) AS BIGINT) AS shelf,
        round({_synth_normal('weight', 12.5, 3.0)}, 4) AS weight,
        round(exp({_synth_normal('value', 2.0, 0.5)}), 4) AS value,
        CASE WHEN {sql_uniform('o_orderkey', 'grade')} < 0.7 THEN 'a'
             WHEN {sql_uniform('o_orderkey', 'grade')} < 0.9 THEN 'b' ELSE 'c' END AS grade,
        printf('box %07d', o_orderkey) AS label,
        TIMESTAMP '2024-03-01 06:00:00' + to_seconds(o_orderkey * 600) AS packed_at
        FROM orders""",
})

ORACLE.update({
    "fill_constant_bad": DO + """, rates AS (
          SELECT round(avg(CAST(o_totalprice IS NULL AS INTEGER)), 6) AS price, round(avg(CAST(o_custkey IS NULL OR o_custkey % 10 = 0 AS INTEGER)), 6) AS small
          FROM dirty_orders)
        SELECT plan, step, col, success, CASE WHEN success THEN 0.0 END AS null_after,
          CASE WHEN fixed THEN 0.0 WHEN col = 'small' THEN small ELSE price END AS left_null
        FROM rates, (VALUES ('both_bad', 0, 'o_totalprice', false, false), ('both_bad', 1, 'small', false, false),
          ('one_bad', 0, 'o_totalprice', true, true), ('one_bad', 1, 'small', false, false), ('alone_bad', 0, 'small', false, false),
          ('alone_good', 0, 'small', true, true), ('both_good', 0, 'o_totalprice', true, true), ('both_good', 1, 'small', true, true))
          AS t(plan, step, col, success, fixed)""",
    "fill_mean": DO + """SELECT o_orderkey, round(coalesce(o_totalprice,
        (SELECT avg(o_totalprice) FROM dirty_orders)), 4) AS o_totalprice FROM dirty_orders""",
    "fill_median": DO + """SELECT o_orderkey, round(coalesce(o_totalprice,
        (SELECT quantile_cont(o_totalprice, 0.5) FROM dirty_orders)), 4) AS o_totalprice FROM dirty_orders""",
    "fill_mode_num": DO + """SELECT o_orderkey, coalesce(o_totalprice,
        (SELECT o_totalprice FROM dirty_orders WHERE o_totalprice IS NOT NULL GROUP BY o_totalprice
         ORDER BY count(*) DESC, o_totalprice LIMIT 1)) AS o_totalprice FROM dirty_orders""",
    "fill_mode_text": DO + """SELECT o_orderkey, coalesce(o_orderpriority,
        (SELECT o_orderpriority FROM dirty_orders WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority
         ORDER BY count(*) DESC, o_orderpriority LIMIT 1)) AS o_orderpriority FROM dirty_orders""",
    "fill_constant": DO + """SELECT o_orderkey, coalesce(o_totalprice, 0.0) AS o_totalprice FROM dirty_orders""",
    "fill_ffill": DE + """SELECT event_id, last_value(value IGNORE NULLS) OVER (ORDER BY ts, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM dirty_events""",
    "dedup_all": DO + "SELECT DISTINCT * FROM dirty_orders",
    "dedup_subset": """SELECT doc_id, lang, n_chars FROM (SELECT doc_id, lang, n_chars,
        row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""",
    "dtype_int": DO + f"""SELECT o_orderkey, CAST({sql_parse_number('qty_text')} AS BIGINT) AS qty_text
        FROM dirty_orders""",
    "dtype_int_check": DO + """SELECT 'o_totalprice' AS "column",
        CAST(count(*) FILTER (WHERE o_totalprice IS NOT NULL AND o_totalprice <> floor(o_totalprice)) AS BIGINT)
          AS n_fractional,
        count(*) FILTER (WHERE o_totalprice IS NOT NULL AND o_totalprice <> floor(o_totalprice)) = 0 AS castable
        FROM dirty_orders""",
    "dtype_float": DO + f"""SELECT o_orderkey, {sql_parse_number('qty_text')} AS qty_text FROM dirty_orders""",
    "dtype_str": DO + """SELECT o_orderkey, coalesce(CAST(o_custkey AS VARCHAR), 'nan') AS o_custkey
        FROM dirty_orders""",
    "dtype_timestamp": DE + """SELECT event_id, TRY_CAST(ts_text AS TIMESTAMP) AS ts_text FROM dirty_events""",
    "dtype_bool": DE + """SELECT event_id, TRY_CAST(flag_text AS BOOLEAN) AS flag_text FROM dirty_events""",
    "clip_iqr": """WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
        b AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
        SELECT event_id, round(CASE WHEN value < lo THEN lo WHEN value > hi THEN hi ELSE value END, 6) AS value
        FROM events, b""",
    "clip_zscore": """WITH s AS (SELECT avg(n_chars) AS m, stddev_samp(n_chars) AS sd FROM documents),
        b AS (SELECT m - 3.0 * sd AS lo, m + 3.0 * sd AS hi FROM s)
        SELECT doc_id, round(CASE WHEN n_chars < lo THEN lo WHEN n_chars > hi THEN hi
          ELSE CAST(n_chars AS DOUBLE) END, 4) AS n_chars FROM documents, b""",
    "clip_percentile": DO + """, b AS (SELECT quantile_cont(o_totalprice, 0.01) AS lo,
          quantile_cont(o_totalprice, 0.99) AS hi FROM dirty_orders)
        SELECT o_orderkey, round(CASE WHEN o_totalprice < lo THEN lo WHEN o_totalprice > hi THEN hi
          ELSE o_totalprice END, 6) AS o_totalprice FROM dirty_orders, b""",
    "rename_drop": DO + """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
        o_orderpriority AS priority, qty_text FROM dirty_orders""",
})


# --- profiling, quality, grading -------------------------------------------------

from scrubspark.catalog import specs  # noqa: E402
from scrubspark.catalog.sqlgen import col_stats_sql, dup_rate_sql, quality_sql  # noqa: E402

DO_STATS = DO + ", " + col_stats_sql("dirty_orders", specs.DIRTY_ORDERS_COLS) + ", " + \
    dup_rate_sql("dirty_orders") + "\n"
DE_STATS = DE + ", " + col_stats_sql("dirty_events", specs.DIRTY_EVENTS_COLS) + ", " + \
    dup_rate_sql("dirty_events") + "\n"


def _r(c):
    return f"round({c}, 4) AS {c}"


_ORDERS_NULL = ("(SELECT avg(CASE WHEN null_rate <= 0.01 THEN 1.0 ELSE greatest(0.0, 1 - null_rate * 5) END) "
                "FROM colstats WHERE name IN ('o_totalprice', 'o_orderpriority'))")
_ORDERS_OUT = ("(SELECT avg(CASE WHEN outlier_frac <= 0.05 THEN 1.0 ELSE greatest(0.0, 1 - outlier_frac * 10) END) "
               "FROM colstats WHERE name = 'o_totalprice' AND n_values >= 4)")
_DUP = ("(SELECT CASE WHEN duplicate_rate < 0.005 THEN 1.0 ELSE greatest(0.0, 1 - duplicate_rate * 10) END "
        "FROM dupstats)")


def _rule_share(view, col, lo, hi):
    x = sql_parse_number(f'"{col}"')
    return (f"(SELECT count(*) FILTER (WHERE {x} BETWEEN {lo} AND {hi}) / nullif(count({x}), 0) FROM {view})")


_ORDERS_RULES = (f"((coalesce({_rule_share('dirty_orders', 'o_totalprice', 0, 600000)}, 0) + "
                 f"coalesce({_rule_share('dirty_orders', 'qty_text', 0, 19)}, 0)) / 2)")
_ORDERS_SCORE = (f"round(least(0.20 * {_ORDERS_NULL} + 0.20 * 0.5 + 0.20 * {_ORDERS_OUT} + 0.15 * {_DUP} "
                 f"+ 0.20 * {_ORDERS_RULES} + 0.0, 1.0), 4)")

_EV_NULL = ("(SELECT avg(CASE WHEN null_rate <= 0.01 THEN 1.0 ELSE greatest(0.0, 1 - null_rate * 5) END) "
            "FROM colstats WHERE name = 'value')")
_EV_OUT = ("(SELECT avg(CASE WHEN outlier_frac <= 0.05 THEN 1.0 ELSE greatest(0.0, 1 - outlier_frac * 10) END) "
           "FROM colstats WHERE name = 'value' AND n_values >= 4)")
_EV_RULES = f"{_rule_share('dirty_events', 'value', -100, 1000)}"
_EV_PARSE = "(SELECT count(CASE WHEN user_id % 6 <> 0 THEN 1 END) / count(*) FROM dirty_events)"
_EV_TYPE = "(2.0 / 3.0)"
_EV_SCORE = (f"round(least(0.20 * {_EV_NULL} + 0.15 * {_EV_TYPE} + 0.15 * {_EV_OUT} + 0.10 * {_DUP} "
             f"+ 0.10 * {_EV_PARSE} + 0.20 * {_EV_RULES} + 0.05, 1.0), 4)")

_ORDERS_TEXT_COLS = [c for c, t in specs.DIRTY_ORDERS_COLS if t == "string"]

ORACLE.update({
    "profile_numeric": DO_STATS + """SELECT name, round(null_rate, 4) AS null_rate, n_unique,
        round(mean, 4) AS mean, round(std, 4) AS std, round(min, 4) AS min, round(max, 4) AS max,
        round(q1, 4) AS q1, round(q3, 4) AS q3, round(outlier_frac, 4) AS outlier_frac
        FROM colstats WHERE is_numeric""",
    "profile_text": DO_STATS + """SELECT name, round(null_rate, 4) AS null_rate, n_unique,
        round(parse_rate, 4) AS parse_rate FROM colstats WHERE dtype = 'string'""",
    "profile_flags": DO_STATS + "SELECT name, flags FROM colstats",
    "profile_samples": DO + ", melt AS (" + " UNION ALL ".join(
        f"SELECT o_orderkey AS k, '{c}' AS name, CAST(\"{c}\" AS VARCHAR) AS val FROM dirty_orders"
        for c, _ in specs.DIRTY_ORDERS_COLS) + """),
        r AS (SELECT name, val, row_number() OVER (PARTITION BY name ORDER BY k) AS rn
              FROM melt WHERE val IS NOT NULL)
        SELECT name, string_agg(val, '|' ORDER BY rn) AS sample_values FROM r WHERE rn <= 3 GROUP BY name""",
    "table_header": DO + ", " + dup_rate_sql("dirty_orders") + """
        SELECT n_rows, CAST(8 AS INTEGER) AS n_cols, round(duplicate_rate, 4) AS duplicate_rate FROM dupstats""",
    "profile_lines": DO_STATS + """SELECT name, '- ' || name || ' [' || dtype || '] nulls=' ||
        printf('%.1f%%', round(null_rate * 100, 1)) || ' unique=' || CAST(n_unique AS VARCHAR) ||
        CASE WHEN mean IS NOT NULL THEN printf(' | mean=%.2f, std=%.2f, min=%.2f, max=%.2f',
          round(mean, 2), round(std, 2), round(min, 2), round(max, 2)) ELSE '' END ||
        ' flags=[' || CASE WHEN flags = '' THEN 'clean' ELSE flags END || ']' AS line FROM colstats""",
    "quality_scores": DO_STATS + "SELECT " + quality_sql(),
    "quality_band": "WITH " + fx.DIRTY_ORDERS_SQL + ", " + fx.DIRTY_EVENTS_SQL + ", "
        + col_stats_sql("dirty_orders", specs.DIRTY_ORDERS_COLS).replace("colstats", "cso") + ", "
        + dup_rate_sql("dirty_orders", "dso") + ", "
        + col_stats_sql("dirty_events", specs.DIRTY_EVENTS_COLS).replace("colstats", "cse") + ", "
        + dup_rate_sql("dirty_events", "dse") + """,
        q AS (SELECT 'dirty_orders' AS table_name, """ + quality_sql("cso", "dso").split(" AS overall")[0]
        .split("AS dup_score, ")[1] + """ AS overall
              UNION ALL SELECT 'dirty_events' AS table_name, """ + quality_sql("cse", "dse")
        .split(" AS overall")[0].split("AS dup_score, ")[1] + """ AS overall)
        SELECT table_name, overall, CASE WHEN overall >= 0.85 THEN 'good' WHEN overall >= 0.6 THEN 'warn'
          ELSE 'bad' END AS band FROM q""",
    "grade_orders": DO_STATS + f"""SELECT round({_ORDERS_NULL}, 4) AS null_check, 0.5::DOUBLE AS type_check,
        round({_ORDERS_OUT}, 4) AS outlier_check, round({_DUP}, 4) AS dup_check,
        round({_ORDERS_RULES}, 4) AS rule_check, 1.0::DOUBLE AS parse_check, 0.0::DOUBLE AS drop_bonus,
        {_ORDERS_SCORE} AS score, {_ORDERS_SCORE} >= 0.80 AS passed""",
    "grade_events": DE_STATS + f"""SELECT round({_EV_NULL}, 4) AS null_check, round({_EV_TYPE}, 4) AS type_check,
        round({_EV_OUT}, 4) AS outlier_check, round({_DUP}, 4) AS dup_check,
        round({_EV_RULES}, 4) AS rule_check, round({_EV_PARSE}, 4) AS parse_check, 0.05::DOUBLE AS drop_bonus,
        {_EV_SCORE} AS score, {_EV_SCORE} >= 0.80 AS passed""",
    "grade_default": DO_STATS + """SELECT round(1 - (SELECT avg(null_rate) FROM colstats), 4) AS null_check,
        round(1 - (SELECT duplicate_rate FROM dupstats), 4) AS dup_check,
        round(((1 - (SELECT avg(null_rate) FROM colstats)) + (1 - (SELECT duplicate_rate FROM dupstats))) / 2, 4)
          AS score,
        round(((1 - (SELECT avg(null_rate) FROM colstats)) + (1 - (SELECT duplicate_rate FROM dupstats))) / 2, 4)
          >= 0.80 AS passed""",
    "range_rules": DO + " " + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {lo}::DOUBLE AS lower, {hi}::DOUBLE AS upper, count({sql_parse_number(f'"{c}"')}) AS n_values,
        round(count(*) FILTER (WHERE {sql_parse_number(f'"{c}"')} BETWEEN {lo} AND {hi})
              / nullif(count({sql_parse_number(f'"{c}"')}), 0), 4) AS in_range_share FROM dirty_orders"""
        for c, lo, hi in [("o_totalprice", 0, 600000), ("qty_text", 0, 19)]),
    "parse_rate": DO + " " + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(count({sql_parse_number(f'"{c}"')}) / count(*), 4) AS parse_rate
        FROM dirty_orders""" for c in _ORDERS_TEXT_COLS),
})


# --- plans and replay -----------------------------------------------------------------

def _sql_double_text(c):
    """A finite double in full: exponent of the power of two taken out, whole part, twice 42 bits (see plans/replay.py)."""
    def of(exponent, half):
        x = f"({c} * {half!r}::DOUBLE * {half!r}::DOUBLE)"
        y = f"(({x} - trunc({x})) * 4398046511104.0::DOUBLE)"
        z = f"(({y} - trunc({y})) * 4398046511104.0::DOUBLE)"
        whole = ", ".join(f"CAST(trunc({v}) AS BIGINT)" for v in (x, y, z))
        return f"concat_ws(':', {exponent}, {whole})"
    tiny, huge = 2.0 ** -32, 2.0 ** 32
    return (f"CASE WHEN {c} = 0 THEN '0:0:0:0' WHEN abs({c}) >= {tiny!r}::DOUBLE AND abs({c}) < {huge!r}::DOUBLE "
            f"THEN {of(0, 1.0)} WHEN abs({c}) >= {huge!r}::DOUBLE THEN {of(64, 2.0 ** -32)} ELSE {of(-64, 2.0 ** 32)} END")


def _sql_quantile(view, c, p):
    """The quantile of numpy's rule from order statistics, in this order of operations: equal to the last bit."""
    return (f"(SELECT CASE WHEN ceil(pos) = floor(pos) THEN v[floor(pos)::BIGINT + 1] ELSE v[floor(pos)::BIGINT + 1] "
            f"+ (v[ceil(pos)::BIGINT + 1] - v[floor(pos)::BIGINT + 1]) * (pos - floor(pos)) END FROM (SELECT "
            f"list_sort(list({c})) AS v, {p!r}::DOUBLE * (count({c}) - 1) AS pos FROM {view} WHERE {c} IS NOT NULL))")


_PQ = sql_parse_number("qty_text")
CLEAN_CHAIN = DO + f""",
s1 AS (SELECT DISTINCT * FROM dirty_orders),
s2 AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
              {_PQ} AS qty_text, admin_note FROM s1),
s3 AS (SELECT o_orderkey, o_custkey, o_orderstatus,
              coalesce(o_totalprice, {_sql_quantile("s2", "o_totalprice", 0.5)}) AS o_totalprice,
              o_orderdate, o_orderpriority, qty_text, admin_note FROM s2),
fences AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM
           (SELECT {_sql_quantile("s3", "o_totalprice", 0.25)} AS q1, {_sql_quantile("s3", "o_totalprice", 0.75)} AS q3)),
s4 AS (SELECT o_orderkey, o_custkey, o_orderstatus,
              CASE WHEN o_totalprice < lo THEN lo WHEN o_totalprice > hi THEN hi ELSE o_totalprice END
                AS o_totalprice,
              o_orderdate, o_orderpriority, qty_text, admin_note FROM s3, fences),
cleaned AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
                   o_orderpriority AS priority, qty_text FROM s4)
"""


def _sql_digest(view, cols):
    parts = []
    for c, t in cols:
        if t == "double":
            text = _sql_double_text(f'"{c}"')
        else:
            text = f'CAST("{c}" AS VARCHAR)'
        parts.append(f"CASE WHEN \"{c}\" IS NULL THEN '~' ELSE length({text}) || ':' || {text} END")
    h = f"md5(concat({', '.join(parts)}))"
    return (f"SELECT count(*) AS n_rows, CAST(sum(('0x' || substr({h}, 1, 15))::BIGINT) AS VARCHAR) AS digest "
            f"FROM {view}")


_CLEANED_COLS = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
                 ("o_totalprice", "double"), ("o_orderdate", "ts"), ("priority", "string"),
                 ("qty_text", "double")]

_NULLS = "NULL::DOUBLE AS null_before, NULL::DOUBLE AS null_after"
_CLIPS = "NULL::BIGINT AS n_outliers, NULL::DOUBLE AS std_before, NULL::DOUBLE AS std_after, " \
         "NULL::DOUBLE AS std_reduction"
_N0 = "(SELECT count(*) FROM dirty_orders)"
_N1 = "(SELECT count(*) FROM s1)"

ORACLE.update({
    "clean_plan": CLEAN_CHAIN + """SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 6)
        AS o_totalprice, o_orderdate, priority, qty_text FROM cleaned""",
    "action_metrics": CLEAN_CHAIN + f"""
        SELECT 0::BIGINT AS step, 'remove_duplicates' AS action_type, true AS success, false AS noop,
          {_N0} AS rows_before, {_N1} AS rows_after, 8 AS cols_after, {_NULLS},
          NULL AS dtype_before, NULL AS dtype_after, {_CLIPS}
        UNION ALL SELECT 1, 'fix_dtype', true, false, {_N1}, {_N1}, 8, {_NULLS}, 'string', 'double', {_CLIPS}
        UNION ALL SELECT 2, 'fill_nulls', true, false, {_N1}, {_N1}, 8,
          round((SELECT (count(*) - count(o_totalprice)) / count(*) FROM s2), 4), 0.0, 'double', 'double', {_CLIPS}
        UNION ALL SELECT 3, 'clip_outliers', true, false, {_N1}, {_N1}, 8, {_NULLS}, 'double', 'double',
          (SELECT count(*) FROM s3, fences WHERE o_totalprice < lo OR o_totalprice > hi),
          round((SELECT stddev_samp(o_totalprice) FROM s3), 4), round((SELECT stddev_samp(o_totalprice) FROM s4), 4),
          round(1 - (SELECT stddev_samp(o_totalprice) FROM s4) / (SELECT stddev_samp(o_totalprice) FROM s3), 4)
        UNION ALL SELECT 4, 'drop_column', true, false, {_N1}, {_N1}, 7, {_NULLS}, 'string', NULL, {_CLIPS}
        UNION ALL SELECT 5, 'rename_column', true, false, {_N1}, {_N1}, 7, {_NULLS}, 'string', NULL, {_CLIPS}
        UNION ALL SELECT 6, 'done', true, false, {_N1}, {_N1}, 7, {_NULLS}, NULL, NULL, {_CLIPS}""",
    "precheck": DO + """SELECT CAST(step0 AS BIGINT) AS step, action_type, "column", status FROM (VALUES
          (0, 'fill_nulls', 'missing_col', 'error'),
          (1, 'clip_outliers', 'o_orderpriority', 'error'),
          (3, 'fill_nulls', 'o_totalprice', 'error'),
          (5, 'rename_column', 'o_custkey', 'error')) AS t(step0, action_type, "column", status)
        UNION ALL SELECT 2, 'fix_dtype', 'o_totalprice',
          CASE WHEN count(*) FILTER (WHERE o_totalprice <> floor(o_totalprice)) > 0 THEN 'error' ELSE 'ok' END
          FROM dirty_orders
        UNION ALL SELECT 4, 'fill_nulls', 'o_orderkey',
          CASE WHEN (count(*) - count(o_orderkey)) / count(*) < 0.005 THEN 'noop' ELSE 'ok' END FROM dirty_orders
        UNION ALL SELECT 6, 'fix_dtype', 'o_orderpriority', 'noop'
        UNION ALL SELECT 7, 'remove_duplicates', NULL,
          CASE WHEN (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_orders))) / count(*) < 0.005
               THEN 'noop' ELSE 'ok' END FROM dirty_orders""",
    "recommend": DO_STATS + """, cands AS (
          SELECT 1 AS prio, 0.0 AS k1, 0 AS k2, 'remove_duplicates' AS action_type, NULL AS "column",
                 NULL AS param, 0.95::DOUBLE AS confidence FROM dupstats WHERE duplicate_rate > 0.005
          UNION ALL SELECT 2, 0.0, ordinal, 'fix_dtype', name, 'float64', 0.85 FROM colstats
                 WHERE flags LIKE '%type_chaos%'
          UNION ALL SELECT 3, -null_rate, ordinal, 'fill_nulls', name,
                 CASE WHEN mean IS NOT NULL THEN 'median' ELSE 'mode' END, 0.80 FROM colstats WHERE null_rate > 0.01
          UNION ALL SELECT 4, 0.0, ordinal, 'clip_outliers', name, 'iqr', 0.80 FROM colstats
                 WHERE flags LIKE '%heavy_outliers%'
          UNION ALL SELECT 5, 0.0, 0, 'done', NULL, NULL, 0.70)
        SELECT CAST(row_number() OVER (ORDER BY prio, k1, k2) AS INTEGER) AS rank, action_type, "column", param,
          confidence FROM cands""",
    # The columns hold at most two decimals, so their sums are exact as whole hundredths.
    "moments_exact": " UNION ALL ".join(f"""SELECT '{c}' AS "column", count({c}) AS n,
        round(sum(CAST(round({c} * 100) AS HUGEINT))::DOUBLE / 100 / count({c}), 8) AS mean_value,
        round(stddev_samp({c}), 6) AS std_value FROM lineitem"""
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")),
    "digest": DO + _sql_digest("dirty_orders", [("o_orderkey", "bigint"), ("o_totalprice", "double"),
                                                ("o_orderpriority", "string"), ("qty_text", "string")]),
    "replay_verify": CLEAN_CHAIN + ", d AS (" + _sql_digest("cleaned", _CLEANED_COLS) + """)
        SELECT true AS replay_ok, n_rows, digest, digest AS replay_digest FROM d""",
})


# --- action-log analytics ---------------------------------------------------------------

SCORED = "WITH " + fx.ACTION_LOG_SQL + """,
capped AS (SELECT * FROM action_log WHERE step < max_steps),
term AS (SELECT *, min(CASE WHEN action_type = 'done' OR step + 1 >= max_steps THEN step END)
           OVER (PARTITION BY run_id) AS terminal_step FROM capped),
valid AS (SELECT *, step = terminal_step AS is_terminal FROM term
          WHERE terminal_step IS NULL OR step <= terminal_step),
v1 AS (SELECT *,
  CASE WHEN NOT success THEN NULL
       WHEN action_type = 'done' THEN 0.0::DOUBLE
       WHEN noop AND action_type IN ('fill_nulls', 'remove_duplicates', 'fix_dtype', 'clip_outliers')
         THEN -0.05::DOUBLE
       WHEN action_type = 'fill_nulls' THEN 0.10::DOUBLE * (1.0 - null_after)
       WHEN action_type = 'remove_duplicates' THEN 0.12::DOUBLE
       WHEN action_type = 'fix_dtype' THEN 0.10::DOUBLE
       WHEN action_type = 'clip_outliers' THEN 0.08::DOUBLE * (1.0 + std_reduction)
       WHEN action_type = 'rename_column' THEN CASE WHEN canonical THEN 0.05::DOUBLE ELSE 0.025::DOUBLE END
       WHEN action_type = 'drop_column' THEN CASE WHEN irrelevant THEN 0.04::DOUBLE ELSE -0.025::DOUBLE END
  END AS action_value,
  max(CASE WHEN action_type = 'fix_dtype' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY step
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen_dtype,
  max(CASE WHEN action_type = 'fill_nulls' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY step
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen_fill
  FROM valid),
v2 AS (SELECT *, coalesce(action_value, -0.03::DOUBLE) AS outcome FROM v1),
v3 AS (SELECT *, -0.01::DOUBLE AS step_penalty,
  CASE WHEN NOT success THEN -0.03::DOUBLE END AS invalid_op,
  CASE WHEN confidence >= 0.75 THEN CASE WHEN outcome > 0 THEN 0.04::DOUBLE ELSE -0.06::DOUBLE END
       ELSE 0.0::DOUBLE END AS confidence_term,
  CASE WHEN success AND action_value > 0 AND (action_type = 'fix_dtype'
       OR (action_type = 'fill_nulls' AND coalesce(seen_dtype, 0) = 1)
       OR (action_type = 'clip_outliers' AND coalesce(seen_fill, 0) = 1)) THEN 0.02::DOUBLE ELSE 0.0::DOUBLE END
    AS ordering_bonus,
  CASE WHEN action_type = 'done' AND step + 1 <= 4 AND grade < 0.80 THEN -0.10::DOUBLE END AS early_exit_penalty,
  CASE WHEN action_type = 'done' THEN CASE WHEN grade >= 0.80 THEN 0.15::DOUBLE ELSE 0.15::DOUBLE * grade END
    END AS done_bonus,
  CASE WHEN action_type = 'done' THEN CASE WHEN replay_ok THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END END AS provenance
  FROM v2),
scored0 AS (SELECT *, round(step_penalty + outcome + confidence_term + ordering_bonus
  + coalesce(early_exit_penalty, 0.0) + coalesce(done_bonus, 0.0) + coalesce(provenance, 0.0), 6) + 0.0 AS reward
  FROM v3),
scored AS (SELECT *,
  round(sum(reward) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6)
    + 0.0 AS cumulative,
  round(sum(reward - coalesce(early_exit_penalty, 0.0)) OVER (PARTITION BY run_id ORDER BY step
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) + 0.0 AS cumulative_stored
  FROM scored0)
"""

_COMP = """comp AS (
  SELECT run_id, step, 'step_penalty' AS k, 1 AS pos, step_penalty AS v FROM scored
  UNION ALL SELECT run_id, step, 'action', 2, action_value FROM scored
  UNION ALL SELECT run_id, step, 'invalid_op', 3, invalid_op FROM scored
  UNION ALL SELECT run_id, step, 'confidence', 4, confidence_term FROM scored
  UNION ALL SELECT run_id, step, 'ordering_bonus', 5, CASE WHEN ordering_bonus > 0 THEN ordering_bonus END
    FROM scored
  UNION ALL SELECT run_id, step, 'early_exit_penalty', 6, early_exit_penalty FROM scored
  UNION ALL SELECT run_id, step, 'done_bonus', 7, done_bonus FROM scored
  UNION ALL SELECT run_id, step, 'provenance', 8, provenance FROM scored),
present AS (SELECT * FROM comp WHERE v IS NOT NULL),
top AS (SELECT run_id, step, k, row_number() OVER (PARTITION BY run_id, step ORDER BY abs(v) DESC, pos) AS rn
        FROM present WHERE k <> 'step_penalty'),
keys AS (SELECT run_id, step, string_agg(k, ',' ORDER BY pos) AS components FROM present GROUP BY run_id, step)"""

ORACLE.update({
    "log_scored": SCORED + """SELECT run_id, step, action_type, round(action_value, 6) AS action_value,
        confidence_term, ordering_bonus, early_exit_penalty, round(done_bonus, 6) AS done_bonus, provenance, reward
        FROM scored""",
    "log_cumulative": SCORED + "SELECT run_id, step, reward, cumulative, cumulative_stored FROM scored",
    "log_ordering": SCORED + """SELECT run_id, step, action_type, ordering_bonus FROM scored
        WHERE ordering_bonus > 0""",
    "log_terminal": SCORED + """SELECT run_id, count(*) AS n_valid, max(terminal_step) AS terminal_step
        FROM valid GROUP BY run_id""",
    "log_breakdown_top": SCORED + ", " + _COMP + """
        SELECT k.run_id, k.step, k.components, coalesce(t.k, 'step') AS dominant
        FROM keys k LEFT JOIN (SELECT * FROM top WHERE rn = 1) t USING (run_id, step)""",
    "log_last_n": SCORED + """SELECT run_id, step, reward FROM (SELECT run_id, step, reward,
        row_number() OVER (PARTITION BY run_id ORDER BY step DESC) AS rn FROM scored) WHERE rn <= 15""",
    "log_explain": SCORED + """SELECT run_id, step, printf('Step %d: %s', CAST(step + 1 AS INTEGER), action_type)
        || CASE WHEN "column" IS NOT NULL THEN printf(' on ''%s''', "column") ELSE '' END
        || printf(' -> reward %+.6f.', reward) AS line FROM scored""",
    "log_moving_avg": SCORED + """SELECT run_id, step, round(ma, 6) + 0.0 AS moving_avg FROM (
        SELECT run_id, step, row_number() OVER (PARTITION BY run_id ORDER BY step) AS rn,
          avg(reward) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS ma
        FROM scored) WHERE rn >= 3""",
    "log_smoothed": """WITH w AS (SELECT user_id, event_id, value,
          row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn,
          count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL),
        k AS (SELECT *, CAST(greatest(1, n // 20) AS INTEGER) AS width FROM w WHERE n > 10)
        SELECT a.user_id, a.event_id, any_value(a.width) AS width, round(avg(b.value), 4) + 0.0 AS moving_avg
        FROM k a JOIN k b ON a.user_id = b.user_id AND b.rn > a.rn - a.width AND b.rn <= a.rn
        WHERE a.rn >= a.width GROUP BY a.user_id, a.event_id""",
    "log_group_mean": SCORED + """SELECT action_type, round(avg(reward), 6) + 0.0 AS mean_reward, count(*) AS n
        FROM scored GROUP BY action_type""",
    "log_run_summary": SCORED + """SELECT run_id, count(*) AS steps, round(sum(reward), 6) + 0.0 AS total_reward,
        round(sum(reward - coalesce(early_exit_penalty, 0.0)), 6) + 0.0 AS total_reward_stored,
        arg_max(grade, step) AS final_grade, arg_max(replay_ok, step) AS replay_ok,
        arg_max(action_type, step) = 'done' AS ended_by_done FROM scored GROUP BY run_id""",
})


# --- replies as text -----------------------------------------------------------------------

def _reply_text(raw):
    t = f"regexp_replace({raw}, '^\\s+|\\s+$', '', 'g')"
    fenced = f"string_split({t}, '```')[2]"
    fenced2 = f"(CASE WHEN lower({fenced}) LIKE 'json%' THEN substr({fenced}, 5) ELSE {fenced} END)"
    body = f"(CASE WHEN starts_with({t}, '```') THEN regexp_replace({fenced2}, '^\\s+|\\s+$', '', 'g') ELSE {t} END)"
    span = f"regexp_extract({body}, '(?s)(\\{{.*\\}})', 1)"
    return f"(CASE WHEN {span} <> '' THEN {span} ELSE {body} END)"


def _replies_sql(valid_types):
    j = _reply_text("raw")
    return ("WITH " + fx.raw_replies_sql(valid_types) + f""",
        txt AS (SELECT event_id, {j} AS j FROM raw_replies),
        p AS (SELECT event_id,
          CASE WHEN json_valid(j) THEN json_extract_string(j, '$.action_type') END AS action_type,
          CASE WHEN json_valid(j) THEN json_extract_string(j, '$.column') END AS "column",
          CASE WHEN json_valid(j) THEN json_extract_string(j, '$.params.strategy') END AS strategy,
          CASE WHEN json_valid(j) THEN TRY_CAST(json_extract(j, '$.confidence') AS DOUBLE) END AS confidence
          FROM txt)
        """)


ORACLE.update({
    "parse_actions": _replies_sql(False) + """SELECT event_id, action_type, "column", strategy, confidence,
        action_type IS NOT NULL AS parsed FROM p""",
    "parse_fallback": _replies_sql(False) + """SELECT event_id, coalesce(action_type, 'done') AS action_type,
        CASE WHEN action_type IS NOT NULL THEN "column" END AS "column",
        CASE WHEN action_type IS NULL THEN 0.5 ELSE confidence END AS confidence,
        action_type IS NOT NULL AS parsed FROM p""",
    "fill_mean_int": f"""WITH d AS (SELECT o_orderkey,
          CASE WHEN {sql_uniform('o_orderkey', 'int_null')} < 0.2 THEN NULL ELSE o_custkey END AS o_custkey FROM orders)
        SELECT o_orderkey, coalesce(o_custkey::DOUBLE, (SELECT avg(o_custkey) FROM d)) AS o_custkey FROM d""",
    "profile_nan": f"""WITH d AS (SELECT CASE WHEN {sql_uniform('event_id', 'nan')} < 0.1 THEN NULL ELSE value END AS v
          FROM events)
        SELECT 'value' AS name, round(1 - count(v) / count(*), 6) AS null_rate, count(DISTINCT v) AS n_unique,
          round(avg(v), 4) AS mean FROM d""",
    "dtype_int_long": "SELECT o_orderkey, 9007199254740993 + o_orderkey AS long_text FROM orders",
    "clamp_confidence": _replies_sql(False) + """SELECT event_id,
        greatest(0.0, least(1.0, coalesce(confidence, 0.5))) AS confidence FROM p""",
    "validate_actions": _replies_sql(True) + f"""SELECT event_id, action_type,
        regexp_replace("column", '^\\s+|\\s+$', '', 'g') AS "column", coalesce(confidence, 0.5) AS confidence,
        CASE WHEN action_type IS NULL OR action_type NOT IN ({", ".join(repr(a) for a in fx.ACTION_TYPES)})
               THEN 'unknown action_type'
             WHEN coalesce(confidence, 0.5) < 0 OR coalesce(confidence, 0.5) > 1 THEN 'confidence out of range'
        END AS reason,
        CASE WHEN action_type IS NULL OR action_type NOT IN ({", ".join(repr(a) for a in fx.ACTION_TYPES)})
               THEN false
             WHEN coalesce(confidence, 0.5) < 0 OR coalesce(confidence, 0.5) > 1 THEN false ELSE true END AS valid
        FROM p""",
    "truncate_history": """SELECT conv_id, turn, role FROM (SELECT conv_id, turn, role,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 4""",
    "csv_roundtrip": """SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey,
        CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_name END AS n_name,
        CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation""",
    "scores_json_sink": DO_STATS.replace("WITH ", "WITH ", 1) + f"""SELECT 'dirty_orders' AS table_name,
        {_ORDERS_SCORE} AS score, {_ORDERS_SCORE} >= 0.80 AS passed""",
})

_EV_FILL = """WITH """ + fx.DIRTY_EVENTS_SQL.strip() + """,
  f AS (SELECT event_id, coalesce(value, (SELECT quantile_cont(value, 0.5) FROM dirty_events)) AS value
        FROM dirty_events),
  b AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM
        (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM f))
"""
ORACLE["stream_clean"] = _EV_FILL + """SELECT event_id, round(CASE WHEN value < lo THEN lo WHEN value > hi THEN hi
    ELSE value END, 6) AS value FROM f, b"""

ORACLE["scores_json_sink"] = (
    "WITH " + fx.DIRTY_ORDERS_SQL + ", " + fx.DIRTY_EVENTS_SQL + ", "
    + col_stats_sql("dirty_orders", specs.DIRTY_ORDERS_COLS) + ", " + dup_rate_sql("dirty_orders") + ", "
    + col_stats_sql("dirty_events", specs.DIRTY_EVENTS_COLS).replace("colstats", "cse") + ", "
    + dup_rate_sql("dirty_events", "dse")
    + f"""
    SELECT 'dirty_orders' AS table_name, {_ORDERS_SCORE} AS score, {_ORDERS_SCORE} >= 0.80 AS passed
    UNION ALL
    SELECT 'dirty_events', {_EV_SCORE.replace('colstats', 'cse').replace('dupstats', 'dse')},
      {_EV_SCORE.replace('colstats', 'cse').replace('dupstats', 'dse')} >= 0.80""")

ORACLE["fill_ffill_balanced"] = ORACLE["fill_ffill"]

ORACLE["profile_header"] = DO_STATS + """, q AS (SELECT """ + quality_sql() + """)
    SELECT 1 AS line_no, 'Rows: ' || CAST(n_rows AS VARCHAR) || ' | Cols: 8 | Duplicate rate: ' ||
      printf('%.1f%%', round(duplicate_rate * 100, 1)) AS line FROM dupstats
    UNION ALL SELECT 2, printf('Quality: overall=%.4f | null_score=%.4f | type_score=%.4f | outlier_score=%.4f | '
      || 'dup_score=%.4f', overall, null_score, type_score, outlier_score, dup_score) FROM q"""

_LI_RULES = """((SELECT count(*) FILTER (WHERE l_quantity BETWEEN 5 AND 45) / count(l_quantity) FROM lineitem)
  + (SELECT count(*) FILTER (WHERE l_discount BETWEEN 0 AND 0.05) / count(l_discount) FROM lineitem)) / 2"""
ORACLE["grade_plain"] = f"""WITH f AS (SELECT quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.75) AS q3,
    (count(*) - count(l_quantity)) / count(*) AS nulls FROM lineitem),
  o AS (SELECT count(*) FILTER (WHERE l_quantity < q1 - 1.5 * (q3 - q1) OR l_quantity > q3 + 1.5 * (q3 - q1))
    / count(l_quantity) AS frac FROM lineitem, f),
  d AS (SELECT ((SELECT count(*) FROM lineitem) - count(*)) / (SELECT count(*) FROM lineitem) AS dup
        FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem)),
  c AS (SELECT CASE WHEN nulls <= 0.01 THEN 1.0::DOUBLE ELSE greatest(0.0, 1 - nulls * 5) END AS a,
    CASE WHEN frac <= 0.05 THEN 1.0::DOUBLE ELSE greatest(0.0, 1 - frac * 10) END AS b,
    CASE WHEN dup < 0.005 THEN 1.0::DOUBLE ELSE greatest(0.0, 1 - dup * 10) END AS e, {_LI_RULES} AS r FROM f, o, d),
  t AS (SELECT *, round(least(0.25 * a + 0.20 + 0.20 * b + 0.15 * e + 0.20 * r, 1.0), 4) AS s FROM c)
  SELECT round(a, 4) AS null_check, 1.0::DOUBLE AS type_check, round(b, 4) AS outlier_check, round(e, 4) AS dup_check,
    round(r, 4) AS rule_check, 1.0::DOUBLE AS parse_check, 0.0::DOUBLE AS drop_bonus, s AS score, s >= 0.80 AS passed FROM t"""
ORACLE["grade_capped"] = """SELECT 0.05::DOUBLE AS drop_bonus, round(least(0.5 + 0.05 + 0.5 * CASE
    WHEN (count(*) - count(l_quantity)) / count(*) <= 0.01 THEN 1.0::DOUBLE
    ELSE greatest(0.0, 1 - 5 * (count(*) - count(l_quantity)) / count(*)) END, 1.0), 4) AS score,
    count(*) > 0 AS passed FROM lineitem"""
ORACLE["csv_text_roundtrip"] = """SELECT doc_id, md5(text) AS text_md5,
    '1234567890123456' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS long_id, doc_id % 2 = 0 AS even,
    CASE WHEN doc_id % 3 = 0 THEN 'Infinity' ELSE '1.5' END AS x_text FROM documents"""


def _auto_clean_sql():
    """The auto-clean rounds as chained CTEs: a table ``a<k>``, its profile ``cs<k>`` and header ``d<k>``, and the
    action that the profile calls for.  The tables follow the order of actions on this fixture; the action of each
    round is decided by that round's own figures, so a wrong decision shows as a differing row.
    """
    text = specs.DIRTY_ORDERS_COLS
    parsed = [(c, "double" if c == "qty_text" else t) for c, t in text]

    def but(view, **made):
        names = ", ".join(f"{made[c]} AS {c}" if c in made else c for c, _ in text)
        return f"SELECT {names} FROM {view}"
    tables = [
        ("SELECT * FROM dirty_orders", text),
        ("SELECT DISTINCT * FROM a0", text),
        (but("a1", qty_text=_PQ), parsed),
        (but("a2", o_totalprice="coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM a2))"), parsed),
        (but("a3", qty_text="coalesce(qty_text, (SELECT quantile_cont(qty_text, 0.5) FROM a3))"), parsed),
        (but("a4", o_orderpriority="coalesce(o_orderpriority, (SELECT o_orderpriority FROM a4 WHERE o_orderpriority "
             "IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))"), parsed),
        (but("a5, (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM cs5 WHERE name = 'o_totalprice')",
             o_totalprice="CASE WHEN o_totalprice < lo THEN lo WHEN o_totalprice > hi THEN hi ELSE o_totalprice END"), parsed),
    ]
    ctes, actions = [], []
    for k, (sql, cols) in enumerate(tables):
        ctes += [f"a{k} AS ({sql})", col_stats_sql(f"a{k}", cols).replace("colstats", f"cs{k}"), dup_rate_sql(f"a{k}", f"d{k}")]

        def first(cond, order="ordinal", k=k):
            return f"(SELECT name FROM cs{k} WHERE {cond} ORDER BY {order} LIMIT 1)"
        actions.append(f"""SELECT {k} AS step, (SELECT duplicate_rate FROM d{k}) > 0.005 AS dup,
            {first("parse_rate > 0.7")} AS chaos, {first("null_rate > 0.01", "null_rate DESC, ordinal")} AS nulls,
            {first("outlier_frac > 0.05")} AS outl""")
    last = len(tables) - 1

    def on_last(expr):
        return expr.replace("colstats", f"cs{last}").replace("dupstats", f"d{last}").replace("dirty_orders", f"a{last}")
    score = on_last(f"round(least(0.20 * {_ORDERS_NULL} + 0.20 + 0.20 * {_ORDERS_OUT} + 0.15 * {_DUP} "
                    f"+ 0.20 * {_ORDERS_RULES}, 1.0), 4)")
    return (DO + ", " + ", ".join(ctes) + ", seen AS (" + " UNION ALL ".join(actions) + f"""),
      graded AS (SELECT {score} AS score)
      SELECT step, CASE WHEN dup THEN 'remove_duplicates' WHEN chaos IS NOT NULL THEN 'fix_dtype'
          WHEN nulls IS NOT NULL THEN 'fill_nulls' WHEN outl IS NOT NULL THEN 'clip_outliers' ELSE 'done' END AS action_type,
        CASE WHEN NOT dup THEN coalesce(chaos, nulls, outl) END AS "column", true AS success, false AS noop,
        score, score >= 0.80 AS passed, CAST({last + 1} AS INTEGER) AS steps FROM seen, graded""")


ORACLE["auto_clean_grade"] = _auto_clean_sql()

ORACLE["table_differences"] = """WITH l AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders),
    r AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 501 = 0 THEN o_totalprice + 1e-9::DOUBLE * o_totalprice ELSE o_totalprice END AS o_totalprice,
            CASE WHEN o_orderkey % 1503 <> 0 THEN o_orderstatus END AS o_orderstatus FROM l WHERE o_orderkey % 997 <> 0
          UNION ALL SELECT -o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM l WHERE o_orderkey % 800 = 0)
    SELECT coalesce(l.o_orderkey, r.o_orderkey) AS o_orderkey, count(l.o_orderkey) AS left_rows, count(r.o_orderkey) AS right_rows,
      CASE WHEN l.o_orderkey IS NULL THEN 'added' WHEN r.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS change,
      concat_ws(',', CASE WHEN l.o_orderkey IS NULL OR r.o_orderkey IS NULL THEN 'o_custkey' END,
        CASE WHEN l.o_orderkey IS NULL OR r.o_orderkey IS NULL OR l.o_totalprice IS DISTINCT FROM r.o_totalprice THEN 'o_totalprice' END,
        CASE WHEN l.o_orderkey IS NULL OR r.o_orderkey IS NULL OR l.o_orderstatus IS DISTINCT FROM r.o_orderstatus THEN 'o_orderstatus' END) AS columns
    FROM l FULL JOIN r ON l.o_orderkey = r.o_orderkey
    WHERE l.o_orderkey IS NULL OR r.o_orderkey IS NULL OR l.o_totalprice IS DISTINCT FROM r.o_totalprice
      OR l.o_orderstatus IS DISTINCT FROM r.o_orderstatus GROUP BY ALL"""
ORACLE["profile_appended"] = DO_STATS + f"""SELECT name, n_rows, round(null_rate, 4) AS null_rate, round(mean, 4) AS mean,
    round(std, 4) AS std, round(min, 4) AS min, round(max, 4) AS max, round(parse_rate, 4) AS parse_rate,
    CASE WHEN n_unique <= {KEEP} THEN round(q1, 6) END AS q1, CASE WHEN n_unique <= {KEEP} THEN round(q3, 6) END AS q3,
    CASE WHEN n_unique <= {KEEP} THEN round(outlier_frac, 6) END AS outlier_frac,
    CASE WHEN n_unique <= {KEEP} THEN n_unique END AS n_unique FROM colstats"""
