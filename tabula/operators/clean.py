"""Projection, cleaning and encoding operators.

All are narrow transformations (no shuffle) except where a small fitted table
(levels, bounds) is computed first; those tables have a proven size bound and
are joined by broadcast or inlined as literals.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabula.functions.scalars import binarize, nan_to_null


# ── X1 ──────────────────────────────────────────────────────────────────────
def normalize_name(name: str) -> str:
    """Trim, blanks → ``_``, lower case."""
    return re.sub(r"\s", "_", name.strip()).lower()


def normalize_columns(df: DataFrame, rename: dict[str, str] | None = None) -> DataFrame:
    """Normalise every column name and apply an optional rename map; fail on collisions."""
    rename = {normalize_name(k): v for k, v in (rename or {}).items()}
    new = [rename.get(normalize_name(c), normalize_name(c)) for c in df.columns]
    seen: dict[str, str] = {}
    for old, n in zip(df.columns, new):
        if n in seen:
            raise ValueError(f"column name collision: {seen[n]!r} and {old!r} both become {n!r}")
        seen[n] = old
    return df.toDF(*new)


# ── X2 ──────────────────────────────────────────────────────────────────────
def unify_schema(df: DataFrame, aliases: dict[str, list[str]],
                 optional: dict[str, str] | None = None) -> DataFrame:
    """Project onto a canonical schema.

    ``aliases`` maps each required output column to the source names it may
    have (first present wins, matched case-insensitively).  ``optional`` maps
    output columns to a type; absent ones become typed NULL.
    """
    lower = {c.lower(): c for c in df.columns}
    cols = []
    for out, names in aliases.items():
        present = [lower[n.lower()] for n in names if n.lower() in lower]
        if not present:
            raise ValueError(f"none of {names} present for required column {out!r}")
        cols.append(F.coalesce(*[F.col(f"`{p}`") for p in present]).alias(out))
    for out, typ in (optional or {}).items():
        cols.append(F.col(f"`{lower[out.lower()]}`").cast(typ).alias(out) if out.lower() in lower
                    else F.lit(None).cast(typ).alias(out))
    return df.select(*cols)


# ── X3 ──────────────────────────────────────────────────────────────────────
def clean_non_finite(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """NaN / ±inf → NULL in fractional columns (all of them when ``cols`` is None)."""
    frac = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    targets = set(cols) if cols is not None else frac
    return df.select(*[nan_to_null(F.col(c)).cast(df.schema[c].dataType).alias(c)
                       if c in targets and c in frac else F.col(c) for c in df.columns])


# ── X4 ──────────────────────────────────────────────────────────────────────
def typed_projection(df: DataFrame, spec: dict[str, str | Column]) -> DataFrame:
    """``{out: 'type'}`` casts the same-named column; ``{out: Column}`` takes an expression.
    Columns not in ``spec`` are dropped."""
    return df.select(*[(F.col(out).cast(v) if isinstance(v, str) else v).alias(out)
                       for out, v in spec.items()])


# ── X5 / X6 ─────────────────────────────────────────────────────────────────
def filter_labelled(df: DataFrame, label: str) -> DataFrame:
    return df.filter(F.col(label).isNotNull())


def binarize_label(df: DataFrame, source, out: str, threshold: int = 7) -> DataFrame:
    """Add ``out`` = 0 if round-half-even(source) < threshold else 1."""
    return df.withColumn(out, binarize(source, threshold))


# ── X7 ──────────────────────────────────────────────────────────────────────
def drop_incomplete(df: DataFrame, cols: list[str], observation: Observation | None = None) -> DataFrame:
    """Drop rows with NULL in any of ``cols``.

    With an ``observation`` the pass that uses the result also counts, at no second scan: ``rows_in``,
    ``rows_dropped`` and, per column, ``null_<column>``; read them with ``observation.get`` after an action.
    (Spark 4.1: models of Spark ML that keep a training summary can't be shipped to tasks in a session that has used
    an observation; observe in a ``spark.newSession()``, or drop the summaries, as ``models.run_grid`` does.)"""
    complete = F.lit(True)
    for c in cols:
        complete = complete & F.col(c).isNotNull()
    if observation is not None:
        df = df.observe(observation, F.count(F.lit(1)).alias("rows_in"), F.count_if(~complete).alias("rows_dropped"),
                        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in cols])
    return df.filter(complete)


# ── X8 / X9 ─────────────────────────────────────────────────────────────────
def category_levels(df: DataFrame, col: str) -> list[str]:
    """Sorted distinct non-null levels (each becomes a column, so all of them are needed)."""
    levels = (df.select(F.col(col).cast("string").alias("v")).where(F.col("v").isNotNull())
              .distinct().orderBy("v").collect())
    return [r["v"] for r in levels]


def one_hot(df: DataFrame, col: str, levels: list[str] | None = None, prefix: str | None = None,
            drop_source: bool = True) -> DataFrame:
    """One flag column per level (double 1.0/0.0); NULL or unseen levels give all zeros.

    With ``levels=None`` the levels present are used (fit on this frame), which
    is the keep-all-levels encoding; pass fitted levels to encode other frames.
    """
    levels = category_levels(df, col) if levels is None else levels
    prefix = col if prefix is None else prefix
    src = F.col(col).cast("string")
    flags = [F.when(src == F.lit(v), F.lit(1.0)).otherwise(F.lit(0.0)).alias(f"{prefix}_{v}")
             for v in levels]
    keep = [F.col(c) for c in df.columns if not (drop_source and c == col)]
    return df.select(*keep, *flags)


# ── X10 / X11 ───────────────────────────────────────────────────────────────
def align_features(df: DataFrame, expected: list[str], strict: bool = False,
                   fill: float = 0.0, keep: list[str] | None = None) -> DataFrame:
    """Select ``expected`` in order; missing columns become ``fill`` (error when strict);
    extra columns are dropped except those listed in ``keep``."""
    present = set(df.columns)
    missing = [c for c in expected if c not in present]
    if strict and missing:
        raise ValueError(f"missing feature columns: {missing}")
    cols = [F.col(c) if c in present else F.lit(float(fill)).alias(c) for c in expected]
    return df.select(*[F.col(k) for k in (keep or []) if k in present and k not in expected], *cols)


# ── X13 ─────────────────────────────────────────────────────────────────────
def split_target(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """Features without the target and the target cast to int (same rows, same order)."""
    return df.drop(target), df.select(F.col(target).cast("int").alias(target))


# ── X22 ─────────────────────────────────────────────────────────────────────
def range_violations(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Per-row flags ``<col>_out`` (NULL values are not violations) plus ``n_violations``."""
    flags = [(F.col(c) < F.lit(lo)) | (F.col(c) > F.lit(hi)) for c, (lo, hi) in bounds.items()]
    flags = [F.coalesce(f, F.lit(False)) for f in flags]
    total = sum((f.cast("int") for f in flags), F.lit(0))
    return df.select("*", *[f.alias(f"{c}_out") for c, f in zip(bounds, flags)],
                     total.alias("n_violations"))


def range_violation_counts(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Long table ``(feature, lo, hi, n_below, n_above, n_rows)`` in one pass."""
    aggs = []
    for c, (lo, hi) in bounds.items():
        aggs += [F.count_if(F.col(c) < F.lit(lo)).alias(f"{c}__below"),
                 F.count_if(F.col(c) > F.lit(hi)).alias(f"{c}__above")]
    wide = df.agg(F.count(F.lit(1)).alias("n_rows"), *aggs)
    rows = [F.struct(F.lit(c).alias("feature"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"),
                     F.col(f"{c}__below").alias("n_below"), F.col(f"{c}__above").alias("n_above"))
            for c, (lo, hi) in bounds.items()]
    return (wide.select(F.col("n_rows"), F.explode(F.array(*rows)).alias("r"))
            .select("r.*", "n_rows"))


# ── X23 / E10 ───────────────────────────────────────────────────────────────
def null_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Long table ``(feature, dtype, n_null, position)`` computed in one aggregate."""
    cols = cols or df.columns
    wide = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(cols)])
    rows = [F.struct(F.lit(c).alias("feature"), F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
                     F.col(f"n{i}").alias("n_null"), F.lit(i).alias("position"))
            for i, c in enumerate(cols)]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


# ── X24 ─────────────────────────────────────────────────────────────────────
def derive_features(df: DataFrame, spec: dict[str, tuple]) -> DataFrame:
    """Spec-driven derived columns.

    ``('log', col, eps)`` → ln(greatest(col, eps));
    ``('ratio', num, den, offset)`` → num / (den + offset);
    ``('mean', a, b)`` → (a + b) / 2;
    ``('flag', col, op, value)`` → 1.0/0.0 for ``col op value`` with op in < <= > >=.
    """
    out = []
    for name, s in spec.items():
        kind = s[0]
        if kind == "log":
            e = F.ln(F.greatest(F.col(s[1]), F.lit(float(s[2]))))
        elif kind == "ratio":
            e = F.col(s[1]) / (F.col(s[2]) + F.lit(float(s[3])))
        elif kind == "mean":
            e = (F.col(s[1]) + F.col(s[2])) / F.lit(2.0)
        elif kind == "flag":
            c, op, v = F.col(s[1]), s[2], F.lit(float(s[3]))
            cond = {"<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v}[op]
            e = F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0))
        else:
            raise ValueError(f"unknown derived feature kind {kind!r}")
        out.append(e.alias(name))
    return df.select("*", *out)
