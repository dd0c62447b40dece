"""Stratified train / validation / test split (S1) and split sizes.

Membership is a pure function of a stable row key, so re-reading the source in
any order or partitioning gives the same split (no leakage between stages).
Per class with ``n`` rows, ranked by ``hash32(seed, key)``:

* the first ``ceil(test_size * n)`` ranks are ``test``;
* of the remaining ``m``, the next ``ceil(val_size * m)`` are ``val``;
* the rest are ``train``.

With the defaults (0.2, then 0.25 of the rest) this is the 60/20/20 split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabula.functions.hashing import hash32
from tabula.operators.ranking import hashed_segments

SPLIT_NAMES = ["test", "val", "train"]


def split_cuts(n: Column, test_size: float = 0.2, val_size: float = 0.25) -> list[Column]:
    n_test = F.ceil(F.lit(test_size) * n)
    n_val = F.ceil(F.lit(val_size) * (n - n_test))
    return [n_test, n_test + n_val]


def stratified_split(df: DataFrame, label: str, key: str, seed: int = 42, test_size: float = 0.2,
                     val_size: float = 0.25, out: str = "split", n_buckets: int | None = None) -> DataFrame:
    """Add ``out`` ∈ {train, val, test}, exact per-class sizes, no single-class window."""
    seg = hashed_segments(df, [label], key, seed, lambda n: split_cuts(n, test_size, val_size),
                          out="_segment", n_buckets=n_buckets)
    names = F.element_at(F.array(*[F.lit(s) for s in SPLIT_NAMES]), F.col("_segment") + 1)
    return seg.withColumn(out, names).drop("_segment")


def hash_split(df: DataFrame, key: str, seed: int = 42, test_size: float = 0.2, val_size: float = 0.25,
               out: str = "split") -> DataFrame:
    """Fast mode: one pass, no shuffle; sizes are exact only in expectation."""
    u = hash32(seed, key) / F.lit(4294967296.0)
    return df.withColumn(out, F.when(u < test_size, "test")
                         .when(u < test_size + (1 - test_size) * val_size, "val").otherwise("train"))


def split_sizes(df: DataFrame, split: str = "split", label: str | None = None) -> DataFrame:
    """Rows and percent of all rows per split (and per class when ``label`` is given).

    The total is a scalar subquery over the small count table (one value),
    not an unpartitioned window over the rows.
    """
    keys = [split] + ([label] if label else [])
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    total = counts.agg(F.sum("n_rows")).scalar()
    return counts.withColumn("pct", F.round(F.col("n_rows").cast("double") * F.lit(100.0)
                                            / total.cast("double"), 1))


def split_class_shares(df: DataFrame, split: str = "split", label: str = "label") -> DataFrame:
    """Per split and class: rows, share of the split (%) and share of the class (%)."""
    counts = df.groupBy(split, label).agg(F.count(F.lit(1)).alias("n_rows"))
    def share(over: str):
        total = F.sum("n_rows").over(Window.partitionBy(over)).cast("double")
        return F.round(F.col("n_rows").cast("double") * F.lit(100.0) / total, 2)

    return counts.withColumn("pct_of_split", share(split)).withColumn("pct_of_class", share(label))
