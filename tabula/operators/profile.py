"""Profiling aggregates.

Each profile is one wide aggregate over the input (partial aggregation on the
map side, a tiny shuffle), reshaped to long form on the one-row result.
Statistics that sum doubles (mean, std, correlation) are reported to a fixed
number of significant digits so results do not depend on summation order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabula.operators.quantiles import exact_quantiles
from tabula.operators.ranking import null_safe_join


def sig(c: Column, digits: int = 10) -> Column:
    """Round a double to ``digits`` significant digits (order-independent reporting)."""
    return F.when(c.isNull(), F.lit(None).cast("double")).otherwise(
        F.format_string(f"%.{digits - 1}e", c).try_cast("double"))


# ── E1 / E2 / E9 ────────────────────────────────────────────────────────────
def class_counts(df: DataFrame, label: str) -> DataFrame:
    """Rows per class, sorted by class."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n_rows")).orderBy(label)


def class_proportions(df: DataFrame, label: str) -> DataFrame:
    """Rows and share (0-1) per class; the total is a scalar subquery on the count table."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"))
    total = counts.agg(F.sum("n_rows")).scalar()
    return counts.withColumn("share", F.col("n_rows").cast("double") / total.cast("double"))


def distinct_classes(df: DataFrame, label: str) -> DataFrame:
    return df.select(label).distinct().orderBy(label)


# ── E3 ──────────────────────────────────────────────────────────────────────
DESCRIBE_PROBS = [0.25, 0.5, 0.75]


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, std (sample), min, q1, median, q3, max per column, one row per column."""
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("count"), sig(F.col(f"m{i}")).alias("mean"),
                     sig(F.col(f"s{i}")).alias("std"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"))
            for i, c in enumerate(cols)]
    base = wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    q = exact_quantiles(df, cols, DESCRIBE_PROBS)
    qw = q.groupBy("column").pivot("prob", DESCRIBE_PROBS).agg(F.first("value"))
    qw = qw.toDF("column", "q1", "median", "q3")
    return base.join(qw, on="column", how="left").select(
        F.col("column").alias("feature"), "count", "mean", "std", "min", "q1", "median", "q3", "max")


# ── E4 ──────────────────────────────────────────────────────────────────────
def histogram(df: DataFrame, cols: Sequence[str], n_bins: int = 30) -> DataFrame:
    """Equal-width bins over [min, max] per column, last bin closed; empty bins included.

    Output ``(column, bin, lo_edge, hi_edge, n_rows)``.  A constant column puts
    every value in bin 0 with zero width; one without values has no rows.  Two passes: the ranges, which
    then stand in the expressions as literals, and the counts.
    """
    value = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in cols]
    ends = df.agg(*[f(v).alias(f"{n}{i}") for i, v in enumerate(value) for n, f in (("lo", F.min), ("hi", F.max))]).first()  # one row
    lo = {i: ends[f"lo{i}"] for i in range(len(cols)) if ends[f"lo{i}"] is not None}
    width = {i: (ends[f"hi{i}"] - x) / float(n_bins) for i, x in lo.items()}

    def place(i: int) -> Column:
        if not width[i] > 0:
            return F.when(value[i].isNotNull(), 0).cast("int")
        at = F.least(F.floor((value[i] - F.lit(lo[i])) / F.lit(width[i])), F.lit(n_bins - 1))
        return F.when(value[i].isNotNull(), at).cast("int")  # least() alone skips NULLs

    grid = [(cols[i], k, x + k * width[i], x + (k + 1) * width[i]) for i, x in lo.items() for k in range(n_bins)]
    grid = df.sparkSession.createDataFrame(grid, "feature string, bin int, lo_edge double, hi_edge double")
    if not lo:
        return grid.withColumn("n_rows", F.lit(0).cast("long"))
    placed = df.select(F.explode(F.array(*[F.struct(F.lit(cols[i]).alias("feature"), place(i).alias("bin")) for i in lo])).alias("p")).select("p.*")
    counts = placed.where("bin is not null").groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n_rows"))
    return grid.join(counts, on=["feature", "bin"], how="left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))


def histogram_markers(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(feature, mean, median)``: the two lines drawn over each histogram; NULLs for a column without values."""
    med = exact_quantiles(df, cols, [0.5]).select("column", F.col("value").alias("median"))
    wide = df.agg(*[F.avg(F.when(~F.isnan(c), F.col(c))).alias(f"m{i}") for i, c in enumerate(cols)])
    means = wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("mean")) for i, c in enumerate(cols)])).alias("r"))
    return means.select("r.*").join(med, "column", "left").select(F.col("column").alias("feature"), "mean", "median")


# ── E5 ──────────────────────────────────────────────────────────────────────
def box_stats(df: DataFrame, cols: Sequence[str], by: str, whisker: float = 1.5) -> DataFrame:
    """Per (class, column): quartiles, whiskers at the most extreme values inside
    ``whisker``·IQR of the quartiles, and the count of values beyond them.  A NULL class is a class."""
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75], group_cols=[by])
    qw = (q.groupBy(by, "column").pivot("prob", [0.25, 0.5, 0.75]).agg(F.first("value"))
          .toDF(by, "column", "q1", "median", "q3"))
    qw = qw.withColumn("iqr", F.col("q3") - F.col("q1")).withColumn(
        "lo_fence", F.col("q1") - F.lit(whisker) * F.col("iqr")).withColumn(
        "hi_fence", F.col("q3") + F.lit(whisker) * F.col("iqr"))
    from tabula.operators.quantiles import to_long
    long = null_safe_join(to_long(df, cols, [by]), qw, [by, "column"], small=True)
    inside = (F.col("x") >= F.col("lo_fence")) & (F.col("x") <= F.col("hi_fence"))
    return long.groupBy(by, "column", "q1", "median", "q3", "iqr").agg(
        F.min(F.when(inside, F.col("x"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("x"))).alias("whisker_hi"),
        F.count_if(~inside).alias("n_fliers")).withColumnRenamed("column", "feature")


# ── E6 / X25 ────────────────────────────────────────────────────────────────
def iqr_bounds(df: DataFrame, cols: Sequence[str], k: float = 1.5) -> DataFrame:
    """``(column, q1, q3, lo, hi)`` with ``lo = q1 - k·IQR`` and ``hi = q3 + k·IQR``."""
    q = exact_quantiles(df, cols, [0.25, 0.75])
    qw = q.groupBy("column").pivot("prob", [0.25, 0.75]).agg(F.first("value")).toDF("column", "q1", "q3")
    iqr = F.col("q3") - F.col("q1")
    return qw.select("column", "q1", "q3", (F.col("q1") - F.lit(k) * iqr).alias("lo"),
                     (F.col("q3") + F.lit(k) * iqr).alias("hi"))


def iqr_outliers(df: DataFrame, cols: Sequence[str], k: float = 1.5) -> DataFrame:
    """Outliers per column and their percent of **all** rows (2 decimals), largest first."""
    b = {r["column"]: (r["lo"], r["hi"]) for r in iqr_bounds(df, cols, k).collect()}  # len(cols) rows
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        lo, hi = b.get(c, (None, None))
        if lo is None:
            aggs.append(F.lit(0).cast("bigint").alias(f"o{i}"))
        else:
            aggs.append(F.count_if((F.col(c) < F.lit(lo)) | (F.col(c) > F.lit(hi))).alias(f"o{i}"))
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"o{i}").alias("n_outliers")) for i, c in enumerate(cols)]
    return (wide.select("_n", F.explode(F.array(*rows)).alias("r"))
            .select(F.col("r.column").alias("feature"), "r.n_outliers",
                    F.round(F.col("r.n_outliers") * F.lit(100.0) / F.col("_n"), 2).alias("pct"))
            .orderBy(F.col("pct").desc(), "feature"))


def iqr_filter(df: DataFrame, cols: Sequence[str], k: float = 1.5) -> DataFrame:
    """Keep rows with every listed column inside its IQR fences (NULLs kept)."""
    b = {r["column"]: (r["lo"], r["hi"]) for r in iqr_bounds(df, cols, k).collect()}
    keep = F.lit(True)
    for c in cols:
        lo, hi = b.get(c, (None, None))
        if lo is not None:
            keep = keep & (F.col(c).isNull() | F.col(c).between(F.lit(lo), F.lit(hi)))
    return df.filter(keep)


# ── E7 / E8 ─────────────────────────────────────────────────────────────────
def correlation_matrix(df: DataFrame, cols: Sequence[str], lower_only: bool = True) -> DataFrame:
    """Pearson correlation per pair (pairwise complete), all pairs in one aggregate.

    ``lower_only`` gives pairs ``(a, b)`` with ``a`` after ``b`` in ``cols`` order.
    """
    pairs = [(a, b) for i, a in enumerate(cols) for j, b in enumerate(cols) if (j < i if lower_only else True)]
    wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}")
                    for i, (a, b) in enumerate(pairs)])
    rows = [F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), sig(F.col(f"c{i}"), 9).alias("corr"))
            for i, (a, b) in enumerate(pairs)]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def target_correlation(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """Correlation of each feature with the target, ordered by absolute value (desc)."""
    wide = df.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(f"c{i}")
                    for i, c in enumerate(cols)])
    rows = [F.struct(F.lit(c).alias("feature"), sig(F.col(f"c{i}"), 9).alias("corr")) for i, c in enumerate(cols)]
    return (wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
            .orderBy(F.abs("corr").desc_nulls_last(), "feature"))


# ── E10 / E12 ───────────────────────────────────────────────────────────────
def total_nulls(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row: total NULL cells over ``cols`` (0 after a complete imputation)."""
    cols = list(cols or df.columns)
    return df.agg(sum((F.count_if(F.col(c).isNull()) for c in cols), F.lit(0)).alias("n_null"))


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))
