"""Exact quantiles without holding a column's distinct values in one buffer.

Spark's ``percentile`` keeps a value→count map per group in one task, which
does not survive a high-cardinality column at scale; ``percentile_approx`` is
bounded but inexact.  This operator is exact and bounded:

1. **Bracket.** One wide aggregate (a column per statistic, no row per column) gives ``n``,
   ``min``, ``max`` and, by the mergeable sketch, two values around each quantile: those at
   ``p ∓ 2 / ACCURACY``, twice the sketch's rank error away on either side.
2. **Count.** A second wide aggregate counts the values below and inside each bracket: the
   exact rank at which the bracket starts.  A bracket that missed its rank (the sketch
   promises it does not) falls back to [min, max].
3. **Pick.** Only rows with a value inside a bracket (a few of ``ACCURACY``) become one row
   per column.  A bracket of one value is resolved at once; one of at most ``exact_rows`` rows by a
   job that ranks just those rows (a window per bracket) and returns the requested ranks;
   a larger one is narrowed by a histogram of ``n_bins`` bins over it (on a logarithmic scale
   where it spans many powers of two) until it is small, a 1024th a round.

So the table is read three times, whatever its size.  Interpolation is ``lo + (hi - lo) * frac``:
linear, like pandas ``quantile`` and DuckDB ``quantile_cont``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabula.operators.ranking import null_safe_join, small_side

#: Accuracy of the sketch: its ranks are off by at most a row in so many.
ACCURACY = 10_000


def to_long(df: DataFrame, cols: Sequence[str], group_cols: Sequence[str] = ()) -> DataFrame:
    """``(group..., column, x)`` with one row per non-null, non-NaN value."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in cols])
    return (df.select(*group_cols, F.explode(pairs).alias("_p"))
            .select(*group_cols, "_p.column", "_p.x").where(F.col("x").isNotNull() & ~F.isnan("x")))


def _ranges_frame(spark, keys, key_types, ranges):
    fields = [T.StructField(k, t, True) for k, t in zip(keys, key_types)]
    fields += [T.StructField("rid", T.IntegerType()), T.StructField("lo", T.DoubleType()),
               T.StructField("hi", T.DoubleType()), T.StructField("log", T.BooleanType())]
    return spark.createDataFrame([(*kv, i, lo, hi, _spans_scales(lo, hi)) for i, (kv, lo, hi) in enumerate(ranges)], T.StructType(fields))


def _spans_scales(lo: float, hi: float) -> bool:
    """Whether equal-width bins would put most scales of [lo, hi] into one bin."""
    least, most = sorted((abs(lo), abs(hi)))
    return math.isinf(most) or lo < 0 < hi or most / 2.0 ** 20 > least


def _scale(x):
    """Monotone image of a double: its power of two with its sign, zero in the middle, the infinities at the ends."""
    size = F.least(F.log2(F.abs(x)), F.lit(1025.0)) + F.lit(1100.0)
    return F.when(x > 0, size).when(x < 0, -size).otherwise(F.lit(0.0))


def _inside(long: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``long`` within the ranges of their key (a null group is a group of its own)."""
    r = small_side(ranges).withColumnsRenamed({k: f"_r_{k}" for k in keys})
    match = (F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi"))
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return long.join(r, match)


def _value(c: str):
    return F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))


def _sketched(df: DataFrame, cols: Sequence[str], probs: Sequence[float], g: list[str]) -> DataFrame:
    """A row per group: per column i its n, lo, hi and q, the two ends of each quantile's bracket in turn."""
    ends = [min(1.0, max(0.0, float(p) + d)) for p in probs for d in (-2 / ACCURACY, 2 / ACCURACY)]
    aggs = []
    for i, c in enumerate(cols):
        v = _value(c)
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"), F.percentile_approx(v, ends, ACCURACY).alias(f"q{i}")]
    return df.groupBy(*g).agg(*aggs)


def _counted(df: DataFrame, cols: Sequence[str], probs: Sequence[float], g: list[str], wide: list, long: DataFrame) -> tuple[list, DataFrame]:
    """(per row of ``wide`` the values below (b) and inside (i) each bracket, ``long`` with only what a bracket may need)."""
    spots = [(i, j) for i in range(len(cols)) for j in range(len(probs))]
    ends = [[(r[f"q{i}"][2 * j], r[f"q{i}"][2 * j + 1]) if r[f"n{i}"] else (None, None) for i, j in spots] for r in wide]
    if not wide:
        return [], long
    if g:
        fields = [df.schema[c] for c in g] + [T.StructField(f"_{e}{i}_{j}", T.DoubleType()) for i, j in spots for e in "az"]
        table = df.sparkSession.createDataFrame([(*r[:len(g)], *[v for e in row for v in e]) for r, row in zip(wide, ends)], T.StructType(fields))
        rows = null_safe_join(df, table, g, small=True)
        at = {(i, j): (F.col(f"_a{i}_{j}"), F.col(f"_z{i}_{j}")) for i, j in spots}
    else:
        rows, at = df, {s: tuple(F.lit(v).cast("double") for v in e) for s, e in zip(spots, ends[0])}
    aggs = []
    for i, j in spots:
        v, (lo, hi) = _value(cols[i]), at[(i, j)]
        aggs += [F.count_if(v < lo).alias(f"b{i}_{j}"), F.count_if((v >= lo) & (v <= hi)).alias(f"i{i}_{j}")]
    got = rows.groupBy(*g).agg(*aggs).collect()
    by_group = {tuple(r[:len(g)]): r for r in got}
    counted = [by_group[tuple(r[:len(g)])] for r in wide]
    missed = any(not (c[f"b{i}_{j}"] <= math.floor((r[f"n{i}"] - 1) * probs[j]) and math.ceil((r[f"n{i}"] - 1) * probs[j]) < c[f"b{i}_{j}"] + c[f"i{i}_{j}"])
                 for r, c in zip(wide, counted) for i, j in spots if r[f"n{i}"])
    if missed:
        return counted, long  # its ranks are searched from [min, max]
    inside = [F.coalesce(_value(cols[i]).between(*at[(i, j)]), F.lit(False)) for i, j in spots]
    return counted, to_long(rows.where(reduce(lambda a, b: a | b, inside)), cols, g)


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    group_cols: Sequence[str] = (), n_bins: int = 1024, exact_rows: int = 100_000,
                    max_keys: int = 100_000) -> DataFrame:
    """Long table ``(group..., column, prob, value)``; NULL value when a column has no values.

    The search state lives on the driver, one entry per (group, column, rank); where there
    are more than ``max_keys`` (group, column) pairs, the groups are searched a part at a time.
    """
    spark = df.sparkSession
    g = list(group_cols)
    keys = [*g, "column"]
    df = df.select(*g, *[F.col(c).cast("double").alias(c) for c in cols if c not in g]) if not set(g) & set(cols) else df
    long = to_long(df, cols, g)
    key_types = [long.schema[k].dataType for k in keys]
    wide = _sketched(df, cols, probs, g).limit(max_keys // max(1, len(cols)) + 1).collect()
    if len(wide) * len(cols) > max_keys:
        groups = df.select(*g).distinct().count()
        parts = max(2, -(-groups * len(cols) * 2 // max_keys))
        part = F.pmod(F.xxhash64(*g), F.lit(parts))
        done = [exact_quantiles(df.where(part == i), cols, probs, g, n_bins, exact_rows, max_keys) for i in range(parts)]
        return reduce(DataFrame.unionByName, done)
    counted, long = _counted(df, cols, probs, g, wide, long)

    # Requests: rank k of key kv, searched in [lo, hi] with `start` values below lo.
    targets = []          # (kv, prob, pos, k_lo, k_hi)
    pending = {}          # (kv, k) -> [lo, hi, start, n_in]
    present = set()
    for r, c in zip(wide, counted):
        for i, name in enumerate(cols):
            kv, n = (*r[:len(g)], name), r[f"n{i}"]
            if not n:
                continue
            present.add(name)
            for j, p in enumerate(probs):
                pos = (n - 1) * float(p)
                k_lo, k_hi = math.floor(pos), math.ceil(pos)
                targets.append((kv, float(p), pos, k_lo, k_hi))
                lo, hi, start, n_in = r[f"q{i}"][2 * j], r[f"q{i}"][2 * j + 1], c[f"b{i}_{j}"], c[f"i{i}_{j}"]
                for k in (k_lo, k_hi):
                    pending[(kv, k)] = [lo, hi, start, n_in] if start <= k < start + n_in else [r[f"lo{i}"], r[f"hi{i}"], 0, n]
    values: dict = {}

    while pending:
        for key, (lo, hi, _, _) in list(pending.items()):
            if lo == hi:
                values[key] = lo
                del pending[key]
        if not pending:
            break
        small = {key: v for key, v in pending.items() if v[3] <= exact_rows}
        large = {key: v for key, v in pending.items() if v[3] > exact_rows}

        if small:
            ranges = sorted({(key[0], v[0], v[1]) for key, v in small.items()}, key=repr)
            rid_of = {rg: i for i, rg in enumerate(ranges)}
            rf = _ranges_frame(spark, keys, key_types, ranges)
            starts = {rid_of[(key[0], v[0], v[1])]: v[2] for key, v in small.items()}
            inside = _inside(long, rf, keys)
            wanted = spark.createDataFrame(
                [(rid_of[(key[0], v[0], v[1])], key[1] - v[2] + 1) for key, v in small.items()],
                "rid int, rn bigint")
            ranked = inside.withColumn("rn", F.row_number().over(Window.partitionBy("rid").orderBy("x")))
            picked = ranked.join(F.broadcast(wanted), on=["rid", "rn"]).select("rid", "rn", "x").collect()
            got = {(r["rid"], r["rn"]): r["x"] for r in picked}
            for key, v in small.items():
                rid = rid_of[(key[0], v[0], v[1])]
                values[key] = got[(rid, key[1] - starts[rid] + 1)]
                del pending[key]

        if large:
            ranges = sorted({(key[0], v[0], v[1]) for key, v in large.items()}, key=repr)
            rid_of = {rg: i for i, rg in enumerate(ranges)}
            rf = _ranges_frame(spark, keys, key_types, ranges)
            at = lambda c: F.when(F.col("log"), _scale(F.col(c))).otherwise(F.col(c))
            width = at("hi") - at("lo")
            # halves where the width of a range of the largest doubles overflows
            share = F.when(width == float("inf"), (at("x") / 2 - at("lo") / 2) / (at("hi") / 2 - at("lo") / 2)) \
                .otherwise((at("x") - at("lo")) / width)
            binned = _inside(long, rf, keys).withColumn("bin", F.greatest(F.lit(0), F.least(
                F.floor(share * n_bins), F.lit(n_bins - 1))).cast("int"))
            hist = binned.groupBy("rid", "bin").agg(F.count(F.lit(1)).alias("cnt"), F.min("x").alias("bmin"),
                                                    F.max("x").alias("bmax")).collect()
            per_range: dict = {}
            for h in hist:
                per_range.setdefault(h["rid"], []).append((h["bin"], h["cnt"], h["bmin"], h["bmax"]))
            for rows in per_range.values():
                rows.sort()
            for key, v in large.items():
                rid = rid_of[(key[0], v[0], v[1])]
                before = v[2]
                for _, cnt, bmin, bmax in per_range[rid]:
                    if key[1] < before + cnt:
                        pending[key] = [bmin, bmax, before, cnt]
                        break
                    before += cnt

    rows = []
    for kv, p, pos, k_lo, k_hi in targets:
        v_lo, v_hi = values[(kv, k_lo)], values[(kv, k_hi)]
        rows.append((*kv, p, v_lo if v_lo == v_hi else v_lo + (v_hi - v_lo) * (pos - k_lo)))
    fields = [T.StructField(k, t, True) for k, t in zip(keys, key_types)]
    fields += [T.StructField("prob", T.DoubleType()), T.StructField("value", T.DoubleType())]
    out = spark.createDataFrame(rows, T.StructType(fields))
    if not g:
        missing = [(c, float(p), None) for c in cols if c not in present for p in probs]
        if missing:
            out = out.unionByName(spark.createDataFrame(missing, out.schema))
    return out


def wide_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list[float]]:
    """Driver-side dict ``column → [value per prob]`` (bounded: len(cols)·len(probs) values)."""
    rows = exact_quantiles(df, cols, probs).collect()
    out = {c: [None] * len(probs) for c in cols}
    index = {float(p): i for i, p in enumerate(probs)}
    for r in rows:
        out[r["column"]][index[float(r["prob"])]] = r["value"]
    return out
