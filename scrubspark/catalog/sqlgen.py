"""Generators of oracle SQL for per-column profile figures (DuckDB dialect)."""

from __future__ import annotations

from scrubspark.functions.numeric import sql_parse_number

NUMERIC = ("bigint", "int", "double", "float", "smallint", "tinyint")


def col_stats_sql(view: str, cols: list[tuple[str, str]]) -> str:
    """One row per column with raw (unrounded) figures:
    ordinal, name, dtype, is_numeric, n_rows, n_values, null_rate, n_unique, mean, std, min, max,
    q1, q3, outlier_frac, parse_rate."""
    parts = []
    for i, (c, t) in enumerate(cols):
        q = f'"{c}"'
        if t in NUMERIC:
            x = f"CAST({q} AS DOUBLE)"
            num = (f"avg({x}) AS mean, CASE WHEN count({x}) = 1 THEN 0.0 ELSE stddev_samp({x}) END AS std, "
                   f"min({x}) AS min, max({x}) AS max, quantile_cont({x}, 0.25) AS q1, "
                   f"quantile_cont({x}, 0.75) AS q3, NULL::DOUBLE AS parse_rate")
            is_num = "true"
        else:
            num = ("NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS min, NULL::DOUBLE AS max, "
                   "NULL::DOUBLE AS q1, NULL::DOUBLE AS q3, ")
            if t == "string":
                num += f"count({sql_parse_number(q)}) / nullif(count({q}), 0) AS parse_rate"
            else:
                num += "NULL::DOUBLE AS parse_rate"
            is_num = "false"
        parts.append(
            f"SELECT {i} AS ordinal, '{c}' AS name, '{t}' AS dtype, {is_num} AS is_numeric, "
            f"count(*) AS n_rows, count({q}) AS n_values, "
            f"(count(*) - count({q})) / count(*) AS null_rate, count(DISTINCT {q}) AS n_unique, {num} "
            f"FROM {view}")
    base = " UNION ALL ".join(parts)
    outl = []
    for i, (c, t) in enumerate(cols):
        if t in NUMERIC:
            outl.append(f"SELECT {i} AS ordinal, count(*) FILTER (WHERE CAST(\"{c}\" AS DOUBLE) < s.q1 - 1.5 * "
                        f"(s.q3 - s.q1) OR CAST(\"{c}\" AS DOUBLE) > s.q3 + 1.5 * (s.q3 - s.q1)) AS n_out "
                        f"FROM {view}, (SELECT q1, q3 FROM colstats_base WHERE ordinal = {i}) s")
    out_sql = " UNION ALL ".join(outl) if outl else "SELECT NULL::INTEGER AS ordinal, 0 AS n_out WHERE false"
    return (f"colstats_base AS ({base}),\n"
            f"colstats_out AS ({out_sql}),\n"
            "colstats AS (SELECT b.*, CASE WHEN b.is_numeric AND b.n_values > 0 THEN o.n_out / b.n_values END "
            "AS outlier_frac, concat_ws(', ', "
            "CASE WHEN b.null_rate > 0.20 THEN 'heavy_nulls' END, "
            "CASE WHEN b.null_rate > 0.01 THEN 'has_nulls' END, "
            "CASE WHEN b.is_numeric AND b.n_values > 0 AND o.n_out / b.n_values > 0.05 THEN 'heavy_outliers' END, "
            "CASE WHEN b.parse_rate > 0.7 THEN 'type_chaos' END) AS flags "
            "FROM colstats_base b LEFT JOIN colstats_out o USING (ordinal))")


def dup_rate_sql(view: str, alias: str = "dupstats") -> str:
    return (f"{alias} AS (SELECT count(*) AS n_rows, (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {view})))"
            f" / count(*) AS duplicate_rate FROM {view})")


def quality_sql(cs: str = "colstats", ds: str = "dupstats") -> str:
    """Select list of the five quality scores from colstats + dupstats."""
    null_s = f"(1 - (SELECT avg(null_rate) FROM {cs}))"
    type_s = (f"(1 - (SELECT count(*) FILTER (WHERE parse_rate > 0.7) FROM {cs}) / "
              f"greatest((SELECT count(*) FILTER (WHERE is_numeric) FROM {cs}), 1))")
    out_s = (f"coalesce(1 - (SELECT avg(outlier_frac) FROM {cs} WHERE is_numeric AND n_values >= 4), 1.0)")
    dup_s = f"(1 - (SELECT duplicate_rate FROM {ds}))"
    return (f"round({null_s}, 4) AS null_score, round({type_s}, 4) AS type_score, "
            f"round({out_s}, 4) AS outlier_score, round({dup_s}, 4) AS dup_score, "
            f"round(({null_s} + {type_s} + {out_s} + {dup_s}) / 4, 4) AS overall")
