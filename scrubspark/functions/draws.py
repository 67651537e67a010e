"""Reproducible per-row random draws.

A draw is a pure function of (seed, salt, row key), so it does not depend on
partitioning, task retries or executor loss, and a SQL engine can recompute
it: the first 8 hex digits of md5("seed|salt|key") read as an unsigned 32-bit
integer, divided by 2**32.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def _key(key: Column | str) -> Column:
    return (F.col(key) if isinstance(key, str) else key).cast("string")


def uniform(key: Column | str, salt: str, seed: int = 42) -> Column:
    """Uniform double in [0, 1) for each row."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(salt), _key(key)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(TWO_POW_32)


def pick(key: Column | str, salt: str, choices: list, seed: int = 42) -> Column:
    """One element of ``choices`` per row, drawn uniformly."""
    arr = F.array(*[F.lit(v) for v in choices])
    idx = (F.floor(uniform(key, salt, seed) * len(choices)) + 1).cast("int")
    return F.element_at(arr, idx)


def sql_uniform(key_expr: str, salt: str, seed: int = 42) -> str:
    """The same draw for the SQL oracle engine."""
    return (f"(('0x' || substr(md5(concat_ws('|', '{seed}', '{salt}', CAST({key_expr} AS VARCHAR))), 1, 8))"
            f"::BIGINT / 4294967296.0::DOUBLE)")


def sql_pick(key_expr: str, salt: str, choices: list, seed: int = 42) -> str:
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else repr(v)
    arr = "[" + ", ".join(lit(v) for v in choices) + "]"
    return f"({arr})[CAST(floor({sql_uniform(key_expr, salt, seed)} * {len(choices)}) AS BIGINT) + 1]"
