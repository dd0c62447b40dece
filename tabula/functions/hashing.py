"""Deterministic pseudo-randomness as column expressions.

``rand()`` depends on partitioning, so every random choice in the library is
a pure function of ``(seed, key, tag)`` through md5.  The same value is
computable in DuckDB: ``('0x' || substr(md5(seed || ':' || key || ':' || tag), 1, 8))::BIGINT``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _text(key) -> Column:
    return (key if isinstance(key, Column) else F.col(key)).cast("string")


def hash32(seed: int, key, tag: str | None = None) -> Column:
    """Unsigned 32-bit integer (as bigint) from md5 of ``seed:key[:tag]``."""
    parts = [F.lit(str(seed)), F.lit(":"), _text(key)]
    if tag is not None:
        parts += [F.lit(":"), F.lit(tag)]
    digest = F.md5(F.concat(*parts))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def uniform(seed: int, key, tag: str | None = None) -> Column:
    """Uniform double in [0, 1)."""
    return hash32(seed, key, tag) / F.lit(TWO_32)


def sql_hash32(seed: int, key_sql: str, tag: str | None = None) -> str:
    """DuckDB text of :func:`hash32` (for oracle SQL)."""
    inner = f"'{seed}:' || CAST({key_sql} AS VARCHAR)"
    if tag is not None:
        inner += f" || ':{tag}'"
    return f"CAST(('0x' || substr(md5({inner}), 1, 8)) AS BIGINT)"
