"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabula.operators.ranking import small_side
from tabula.session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only.  Pure-ASCII texts take the built-in ``lower``, which does the same there."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(
        F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A column captured by a lambda may be inlined by the optimizer and then be
    computed again for every element; a lambda variable never is."""
    return F.transform(F.array(value), body)[0]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has (in any letter case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder as Parquet and read back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hinted(small: DataFrame) -> DataFrame:
    """``small`` (stored, so cheap to measure) with a broadcast hint if its rows times their greatest width
    stay under 32 MB; else the planner shuffles, and AQE splits a skewed large side."""
    return small_side(small)
