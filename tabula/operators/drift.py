"""Drift and alerting (X27): population stability index on shared bins, metric alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def psi_table(reference: DataFrame, current: DataFrame, col: str, n_bins: int = 10,
              floor: float = 1e-6) -> DataFrame:
    """Per bin ``(bin, expected_share, actual_share, psi_term)``; the PSI is the sum of the terms.

    Bins are equal-width over the reference range (a one-row aggregate);
    values outside it go to the end bins.  Shares are floored at ``floor``.
    """
    ref = reference.select(F.col(col).cast("double").alias("x")).where(F.col("x").isNotNull())
    cur = current.select(F.col(col).cast("double").alias("x")).where(F.col("x").isNotNull())
    rng = ref.agg(F.min("x").alias("lo"), ((F.max("x") - F.min("x")) / F.lit(float(n_bins))).alias("w")).first()
    lo, w = rng["lo"], rng["w"]

    def binned(df: DataFrame) -> DataFrame:
        if lo is None:
            return df.select(F.lit(0).alias("bin"))
        b = (F.greatest(F.least(F.floor((F.col("x") - F.lit(lo)) / F.lit(w)), F.lit(n_bins - 1)), F.lit(0))
             if w and w > 0 else F.lit(0))
        return df.select(b.cast("int").alias("bin"))

    rb, cb = binned(ref), binned(cur)
    n_ref = rb.agg(F.count(F.lit(1))).scalar().cast("double")
    n_cur = cb.agg(F.count(F.lit(1))).scalar().cast("double")
    re = rb.groupBy("bin").agg(F.count(F.lit(1)).alias("n_e"))
    ce = cb.groupBy("bin").agg(F.count(F.lit(1)).alias("n_a"))
    bins = reference.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    sh = (bins.join(re, on="bin", how="left").join(ce, on="bin", how="left")
          .select("bin", F.greatest(F.coalesce("n_e", F.lit(0)) / n_ref, F.lit(floor)).alias("expected_share"),
                  F.greatest(F.coalesce("n_a", F.lit(0)) / n_cur, F.lit(floor)).alias("actual_share")))
    return sh.withColumn("psi_term", (F.col("actual_share") - F.col("expected_share"))
                         * F.ln(F.col("actual_share") / F.col("expected_share")))


def psi(reference: DataFrame, current: DataFrame, col: str, n_bins: int = 10) -> DataFrame:
    return psi_table(reference, current, col, n_bins).agg(F.sum("psi_term").alias("psi"))


def metric_alerts(metrics: DataFrame, thresholds: dict[str, float], run: str = "run") -> DataFrame:
    """Rows ``(run, metric, value, threshold)`` for every metric below its threshold."""
    rows = []
    for m, t in thresholds.items():
        rows.append(metrics.where(F.col(m) < F.lit(t)).select(
            run, F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(float(t)).alias("threshold")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
