"""DuckDB text fragments used by the oracle SQL of registered queries.

They reproduce, in the independent engine, the few places where two engines
disagree by default (rounding of doubles, md5-derived hashes, double constants).
"""

from __future__ import annotations

from tabula.functions.hashing import sql_hash32


def dbl(x: float) -> str:
    """A double constant (DuckDB reads ``0.2`` as an exact decimal; Spark as a double)."""
    return f"CAST({float(x)!r} AS DOUBLE)"


def rnd(expr: str, d: int) -> str:
    """Spark ``round`` (half up on the shortest decimal text of the double)."""
    return f"CAST(round(CAST(CAST(({expr}) AS VARCHAR) AS DECIMAL(38,18)), {d}) AS DOUBLE)"


def brnd(expr: str, d: int) -> str:
    """Spark ``bround`` (half even on the shortest decimal text of the double)."""
    return f"CAST(round_even(CAST(CAST(({expr}) AS VARCHAR) AS DECIMAL(38,18)), {d}) AS DOUBLE)"


def binarize(expr: str, threshold: int = 7) -> str:
    return (f"CASE WHEN ({expr}) IS NULL THEN NULL "
            f"WHEN CAST(round_even(CAST(({expr}) AS DOUBLE), 0) AS INTEGER) < {threshold} THEN 0 ELSE 1 END")


def h32(seed: int, key: str, tag: str | None = None) -> str:
    return sql_hash32(seed, key, tag)


def finite(expr: str) -> str:
    """NULL for NaN / ±inf, as the library's cleaning step does."""
    return f"CASE WHEN isnan({expr}) OR isinf({expr}) THEN NULL ELSE {expr} END"
