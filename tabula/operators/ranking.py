"""Global ranks and running totals without a single-partition window.

Two shapes recur in the library:

* **Hashed rank cut** (S1 split, B1 quota): rows of each group are ordered by
  a keyed hash and cut at ranks that depend on the group size.  A window over
  the whole group would put a hot group (a third of all rows) in one task.
  Instead: count rows per (group, hash bucket) — a small table — take running
  offsets over it, and rank only the rows of the (one per cut) buckets that hold a
  cut, by a window over (group, bucket).  That gives the row at each cut; every
  row is then compared with its group's cut rows.

* **Running totals over a global order** (M4 ROC): the rows are range-partitioned
  by group and value, per-range totals give offsets, and the running sum inside
  a range is a window over that range only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabula.functions.hashing import hash32
from tabula.session import cut_lineage

# Hash ranges that the rows of a group are counted in (a power of two).
BUCKETS = 1 << 16
# Bytes of a table that may be broadcast once its rows and widest values are known.
BROADCAST_BYTES = 32 << 20


def small_side(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if its rows times their greatest width fit ``BROADCAST_BYTES``."""
    wide = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DatetimeType))]
    row = df.agg(F.count(F.lit(1)), *[F.max(F.octet_length(F.col(c).cast("string"))) for c in wide]).first()
    width = 16 * len(df.columns) + sum(x or 0 for x in row[1:])
    return F.broadcast(df) if row[0] * width <= BROADCAST_BYTES else df


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join with ``small`` broadcast only when its measured size allows it.

    Above the bound the join is left to the planner (sort-merge / AQE).
    The caller passes tables that are already aggregates, so the measurement is cheap.
    """
    return big.join(small_side(small), on=on, how=how)


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", small: bool = False) -> DataFrame:
    """Join by columns of the same name where NULL equals NULL; the key columns are those of ``left``.

    ``small``: the right side is measured and broadcast if it fits, as in :func:`join_small`."""
    names = {c: f"_ns_{i}" for i, c in enumerate(on)}
    side = right.select(*[F.col(c).alias(names.get(c, c)) for c in right.columns])
    side = small_side(side) if small else side
    match = F.lit(True)
    for c, n in names.items():
        match = match & left[c].eqNullSafe(F.col(n))
    return left.join(side, match, how).drop(*names.values())


def hashed_segments(df: DataFrame, group_cols: Sequence[str], key: str, seed: int,
                    cuts: Callable[[Column], list[Column]], out: str = "segment",
                    n_buckets: int | None = None, tag: str | None = None) -> DataFrame:
    """Label each row with the index of the rank interval it falls into.

    Rows of a group are ordered by ``(hash32(seed, key, tag), key)``; rank ``r``
    is 0-based.  ``cuts(n)`` returns increasing cut ranks as columns of the
    group size ``n``; the segment is the number of cuts ``<= r``.  Exact where keys are
    unique in their group (rows of one key stay in one segment).  Three passes: bucket counts, the rows of the buckets that
    hold a cut (the only ones that are windowed), and the labels.  A NULL group is a group.
    """
    group_cols = list(group_cols)
    n_buckets = n_buckets or BUCKETS
    shift = 32 - (n_buckets.bit_length() - 1)
    if 1 << (32 - shift) != n_buckets:
        raise ValueError("n_buckets must be a power of two")
    keyed = df.withColumn("_h", hash32(seed, key, tag)).withColumn("_b", F.shiftright(F.col("_h"), shift))

    # 1. Rows per (group, bucket), and the bucket that each cut's rank falls into.
    gw = Window.partitionBy(*group_cols)
    ow = gw.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (keyed.groupBy(*group_cols, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
               .withColumn("_n", F.sum("_cnt").over(gw))
               .withColumn("_start", F.coalesce(F.sum("_cnt").over(ow), F.lit(0))))
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), c.cast("long").alias("rank")) for i, c in enumerate(cuts(F.col("_n")))])
    cut = buckets.select(*group_cols, "_b", "_start", "_cnt", F.explode(ranks).alias("_c")).where(
        (F.col("_c.rank") >= F.col("_start")) & (F.col("_c.rank") < F.col("_start") + F.col("_cnt")))
    cut = cut_lineage(cut.select(*group_cols, "_b", "_start", F.col("_c.i").alias("_i"), F.col("_c.rank").alias("_rank")))
    # 2. The row at each cut: only rows of those buckets are put in order.
    near = null_safe_join(keyed.select(*group_cols, "_b", "_h", F.col(key).alias("_key")), cut, [*group_cols, "_b"], small=True)
    place = F.col("_start") + F.row_number().over(Window.partitionBy(*group_cols, "_b", "_i").orderBy("_h", "_key")) - 1
    at = near.withColumn("_r", place).where(F.col("_r") == F.col("_rank"))
    marks = cut_lineage(at.groupBy(*group_cols).agg(F.collect_list(F.struct("_h", "_key")).alias("_marks")))  # a row per group, an element per cut
    # 3. One narrow pass: the segment is the number of cut rows that the row does not come before.
    own = F.struct(F.col("_h"), F.col(key).alias("_key"))
    reached = F.size(F.filter(F.coalesce("_marks", F.array().cast(marks.schema["_marks"].dataType)), lambda m: own >= m))
    return null_safe_join(keyed, marks, group_cols, "left", small=True).withColumn(out, reached).drop("_h", "_b", "_marks")


def running_totals(df: DataFrame, order_col: str, value_cols: Sequence[str], descending: bool = False,
                   partition_cols: Sequence[str] = (), with_next: Sequence[str] = ()) -> DataFrame:
    """Add ``cum_<v>`` = sum of ``v`` over rows at or before this one in ``order_col`` order.

    ``order_col`` values must be unique within ``partition_cols`` (aggregate
    ties first).  The rows are range-partitioned by group and order, so the
    ranges follow each group's own values and their number is the session's
    shuffle partitions; the range of every row is written down once
    (checkpoint).  Each range's running sum is a window over that range only,
    shifted by the totals of the ranges before it.  ``with_next`` adds
    ``next_<v>``: the value on the following row (NULL on the last), taken
    across range borders through the small table of each range's first row.
    """
    partition_cols = list(partition_cols)
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    ranged = cut_lineage(df.repartitionByRange(*partition_cols, order).withColumn("_rng", F.spark_partition_id()))

    totals = ranged.groupBy(*partition_cols, "_rng").agg(*[F.sum(v).alias(f"_t_{v}") for v in value_cols])
    tw = Window.partitionBy(*partition_cols).orderBy("_rng").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*partition_cols, "_rng",
                            *[F.coalesce(F.sum(f"_t_{v}").over(tw), F.lit(0)).alias(f"_o_{v}")
                              for v in value_cols])
    iw = (Window.partitionBy(*partition_cols, "_rng").orderBy(order)
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    lw = Window.partitionBy(*partition_cols, "_rng").orderBy(order)
    inner = ranged.select("*", *[F.sum(v).over(iw).alias(f"_c_{v}") for v in value_cols],
                          *[F.lead(v).over(lw).alias(f"_l_{v}") for v in with_next],
                          *([F.row_number().over(lw).alias("_rn")] if with_next else []))
    if with_next:
        firsts = inner.where(F.col("_rn") == 1).select(*partition_cols, F.col("_rng").alias("_nr"),
                                                        *[F.col(v).alias(f"_f_{v}") for v in with_next])
        nw = Window.partitionBy(*partition_cols).orderBy("_rng")
        nxt = offsets.select(*partition_cols, "_rng", F.lead("_rng").over(nw).alias("_nr"))
        nxt = null_safe_join(nxt, firsts, [*partition_cols, "_nr"], "left").drop("_nr")
        offsets = null_safe_join(offsets, nxt, [*partition_cols, "_rng"], "left")
    joined = null_safe_join(inner, offsets, [*partition_cols, "_rng"], small=True)
    return joined.select(*df.columns, *[(F.col(f"_o_{v}") + F.col(f"_c_{v}")).alias(f"cum_{v}")
                                         for v in value_cols],
                         *[F.coalesce(F.col(f"_l_{v}"), F.col(f"_f_{v}")).alias(f"next_{v}") for v in with_next])
