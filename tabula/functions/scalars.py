"""Scalar column helpers (all JVM-side built-ins, no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def nan_to_null(c) -> Column:
    """NaN, +inf and -inf become NULL (pandas writes them as missing)."""
    c = as_col(c)
    bad = F.isnan(c) | (c == F.lit(float("inf"))) | (c == F.lit(float("-inf")))
    return F.when(bad, F.lit(None).cast("double")).otherwise(c)


def safe_double(c, default: float = 0.0) -> Column:
    """Parse to double, falling back to ``default`` when missing or unparsable."""
    return F.coalesce(F.trim(as_col(c).cast("string")).try_cast("double"), F.lit(float(default)))


def round_half_even_int(c) -> Column:
    """Integer cast that agrees between engines: half-even rounding then cast."""
    return F.bround(as_col(c).cast("double"), 0).cast("int")


def binarize(c, threshold: int = 7) -> Column:
    """0 when the rounded value is below ``threshold``, else 1 (NULL stays NULL)."""
    r = round_half_even_int(c)
    return F.when(r.isNull(), F.lit(None).cast("int")).when(r < threshold, F.lit(0)).otherwise(F.lit(1))


def bucketize(c, cuts: list[float]) -> Column:
    """Class index by cut points: ``x < cuts[0]`` → 0, ``cuts[i-1] <= x < cuts[i]`` → i, else len(cuts)."""
    c = as_col(c)
    expr = F.when(c.isNull(), F.lit(None).cast("int"))
    for i, cut in enumerate(cuts):
        expr = expr.when(c < F.lit(float(cut)), F.lit(i))
    return expr.otherwise(F.lit(len(cuts)))


# Icon prefixes removed from prediction labels.
LABEL_ICONS = ["🔴 ", "🟢 ", "🟡 "]


def clean_label(c) -> Column:
    """Strip the icon prefixes and surrounding blanks from a label."""
    out = as_col(c).cast("string")
    for icon in LABEL_ICONS:
        out = F.replace(out, F.lit(icon), F.lit(""))
    return F.trim(out)


def percent_text(c, decimals: int = 1) -> Column:
    """``0.873`` → ``'87.3%'``."""
    return F.format_string(f"%.{decimals}f%%", as_col(c) * F.lit(100.0))
