"""Deterministic uniforms from keys: the same in Spark and in the SQL oracle, at every partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKETS = 4294967296


def u(key: Column | str, seed: str = "") -> Column:
    """The key's md5 bucket scaled to [0, 1)."""
    key = F.col(key) if isinstance(key, str) else key
    text = F.concat(F.lit(seed), key.cast("string")) if seed else key.cast("string")
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(BUCKETS))


def u_sql(key: str, seed: str = "") -> str:
    """:func:`u` as DuckDB SQL."""
    text = f"'{seed}' || CAST({key} AS VARCHAR)" if seed else f"CAST({key} AS VARCHAR)"
    return f"(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) / {BUCKETS}.0)"
