"""Ordering, top-k and history views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, ts: str, key: str, n: int) -> DataFrame:
    """Newest ``n`` rows (ties by key).  ``orderBy(...).limit(n)`` plans as
    TakeOrderedAndProject: a per-partition top-n, never a full sort."""
    return df.orderBy(F.col(ts).desc(), F.col(key).asc()).limit(n)


def tail(df: DataFrame, ts: str, key: str, n: int = 20) -> DataFrame:
    """The last ``n`` rows of the history, returned oldest first."""
    last = df.orderBy(F.col(ts).desc(), F.col(key).desc()).limit(n)
    return last.orderBy(F.col(ts).asc(), F.col(key).asc())
