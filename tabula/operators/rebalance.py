"""Class rebalancing: SMOTE (B1), SMOTE-NC (B2), Tomek links.

Randomness is keyed (``hash32(seed, key, tag)``) so results do not depend on
partitioning and are reproducible by an independent engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabula.functions.hashing import TWO_32, hash32
from tabula.operators.neighbors import finite_vector, knn, mutual_pairs
from tabula.operators.ranking import hashed_segments, join_small, null_safe_join
from tabula.session import cut_lineage

# Synthetic rows that one row is multiplied into at a time.
SLOT_CHUNK = 1 << 16


def class_sizes(df: DataFrame, label: str) -> dict:
    """Class → rows (one collected row per class)."""
    rows = df.groupBy(label).count().collect()
    return {r[label]: r["count"] for r in rows}


def smote(df: DataFrame, label: str, id_col: str, vec: str, k: int = 5, seed: int = 42,
          keep_originals: bool = True, neighbours: DataFrame | None = None) -> DataFrame:
    """Over-sample every non-majority class to the majority size with synthetic rows.

    For class ``c`` with ``n`` rows and ``m`` rows to add, base row ``i`` gets
    ``m // n`` slots, plus one more if its keyed-hash rank is below ``m % n``
    (exact total, no window over the class; ``n`` counts rows with a finite vector, as only those
    have neighbours and can be a base).  Slot ``j`` of base ``i`` takes
    neighbour number ``1 + hash(i:j,'nn') mod min(k, n-1)`` among its k nearest
    same-class rows and the gap ``u = hash(i:j,'gap') / 2³²``; the new vector
    is ``x + u·(neighbour − x)``.

    Output: ``(label, id, vec, base_id, slot, nn_id, gap)``; the originals
    (when kept) have NULL ``base_id``/``slot``/``nn_id``/``gap`` and their own id;
    synthetic ids are ``'<base>:<slot>'`` strings, originals their id as text.
    ``neighbours`` may pass a precomputed same-class ``knn`` result ``(qid, rank, nid)``.
    Rows without a label are no class: they are kept and nothing is added for them.
    """
    base = df.select(F.col(id_col).alias("base_id"), F.col(label).alias("_y"), F.col(vec).cast("array<double>").alias("_x"))
    # m: rows to add up to the largest class; n: rows that can be a base, those with a finite vector.
    sizes = cut_lineage(base.where(F.col("_y").isNotNull()).groupBy("_y").agg(
        F.count(F.lit(1)).alias("_all"), F.count_if(finite_vector(F.col("_x"))).alias("_n")))
    largest = sizes.agg(F.max("_all")).first()[0] or 0
    plan = sizes.select("_y", (F.lit(largest) - F.col("_all")).alias("_m"), "_n").where("_m > 0")
    short = [r["_y"] for r in plan.where("_n < 2").orderBy("_y").limit(20).collect()]
    if short:
        raise ValueError(f"SMOTE needs at least 2 rows with finite vectors in classes {short}")
    minority = join_small(base.where(finite_vector(F.col("_x"))), plan, on="_y")
    # Rank by keyed hash inside each class (_m and _n are the class's own): segment 0 = the first m % n rows.
    seg = hashed_segments(minority, ["_y", "_m", "_n"], "base_id", seed, lambda n: [F.pmod(F.col("_m"), n)], out="_extra", tag="base")
    quota = F.floor(F.col("_m") / F.col("_n")) + F.when(F.col("_extra") == 0, 1).otherwise(0)
    minority = minority.drop("_m", "_n")
    if neighbours is None:
        neighbours = minority_neighbours(minority, "_y", "base_id", "_x", k, seed)
    # The k neighbours with their vectors go to the base row before it is multiplied, so no
    # join sees the synthetic rows and a base row of very many slots is no hot key.
    near = (neighbours.join(minority.select(F.col("base_id").alias("nid"), F.col("_x").alias("x")), on="nid")
            .groupBy(F.col("qid").alias("base_id"))
            .agg(F.array_sort(F.collect_list(F.struct("rank", "nid", "x"))).alias("_near")))
    based = seg.withColumn("_q", quota.cast("long")).where(F.col("_q") > 0).join(near, on="base_id")
    # Slots in chunks spread over the tasks: no row holds more than SLOT_CHUNK of them.
    chunks = (based.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("_q") - 1) / SLOT_CHUNK))))
              .repartition("base_id", "_chunk"))
    first = F.col("_chunk") * SLOT_CHUNK
    slots = chunks.withColumn("slot", F.explode(
        F.transform(F.sequence(first, F.least(first + SLOT_CHUNK, F.col("_q")) - 1), lambda i: i.cast("int"))))
    slot_key = F.concat(F.col("base_id").cast("string"), F.lit(":"), F.col("slot").cast("string"))
    k_eff = F.least(F.lit(k), F.size("_near"))
    slots = (slots.withColumn("_key", slot_key)
             .withColumn("_nn", F.element_at("_near", (F.pmod(hash32(seed, F.col("_key"), "nn"), k_eff) + 1).cast("int")))
             .withColumn("gap", hash32(seed, F.col("_key"), "gap") / F.lit(TWO_32)))
    synth = slots.select(
        F.col("_y").alias(label), F.col("_key").alias("id"),
        F.zip_with("_x", "_nn.x", lambda a, b: a + F.col("gap") * (b - a)).alias(vec),
        "base_id", "slot", F.col("_nn.nid").alias("nn_id"), "gap")
    if not keep_originals:
        return synth
    originals = base.select(F.col("_y").alias(label), F.col("base_id").cast("string").alias("id"),
                            F.col("_x").alias(vec), F.lit(None).cast(synth.schema["base_id"].dataType).alias("base_id"),
                            F.lit(None).cast("int").alias("slot"),
                            F.lit(None).cast(synth.schema["nn_id"].dataType).alias("nn_id"),
                            F.lit(None).cast("double").alias("gap"))
    return originals.unionByName(synth)


def minority_neighbours(df: DataFrame, label: str, id_col: str, vec: str, k: int = 5, seed: int = 42, n_cat: int = 0) -> DataFrame:
    """Same-class k nearest neighbours of every row (materialised: read twice downstream)."""
    return cut_lineage(knn(df, df, k, id_col, id_col, vec, group=label, exclude_self=True, seed=seed, n_cat=n_cat))


def with_codes(df: DataFrame, cols: list[str]) -> DataFrame:
    """``df`` plus ``_code<i>``, a number for each level of ``cols[i]`` (NULL is a level): a dictionary table of the levels is
    joined, so their number meets no limit of columns or expressions."""
    for i, c in enumerate(cols):
        levels = cut_lineage(df.select(c).distinct().withColumn(f"_code{i}", F.monotonically_increasing_id().cast("double")))
        df = null_safe_join(df, levels, [c], "left", small=True)
    return df


def _most_frequent(values: Column) -> Column:
    """The most frequent element, ties to the smallest (an array of at most k values)."""
    counted = F.transform(F.array_sort(F.array_distinct(values)), lambda v: F.struct(F.size(F.filter(values, lambda x: x == v)).alias("n"), v.alias("v")))
    return F.aggregate(counted, F.get(counted, F.lit(0)), lambda a, x: F.when(x["n"] > a["n"], x).otherwise(a))["v"]


def smote_nc(df: DataFrame, label: str, id_col: str, num_vec: str, cat_cols: list[str], k: int = 5,
             seed: int = 42) -> DataFrame:
    """SMOTE for mixed data (B2): continuous part interpolated as in :func:`smote`;
    each categorical takes the most frequent value among the base row's k
    neighbours (ties to the smallest value, NULLs don't vote).  ``med`` being the median of the class's
    continuous standard deviations, a category that differs adds ``med² / 2`` to the
    squared distance: what one-hot flags of height ``med / 2`` would add.  Levels are codes of a joined
    dictionary, so 100,000 of them cost no more than two.
    """
    num = df.where(finite_vector(F.col(num_vec))).select(
        F.posexplode(F.col(num_vec).cast("array<double>")).alias("d", "x"), F.col(label).alias("_y"))
    sds = num.groupBy("_y", "d").agg(F.stddev_pop("x").alias("sd"))
    med = sds.groupBy("_y").agg(F.median("sd").alias("_med"))
    sizes = cut_lineage(df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("_y")).agg(F.count(F.lit(1)).alias("_all")))
    largest = sizes.agg(F.max("_all")).first()[0] or 0
    classes = cut_lineage(sizes.where(F.col("_all") < largest).join(med, "_y").select("_y", "_med"))
    rows = df.select(F.col(id_col).alias("_id"), F.col(label).alias("_y"), F.col(num_vec).cast("array<double>").alias("_num"), *cat_cols)
    minority = cut_lineage(join_small(rows, classes, on="_y"))
    coded = with_codes(minority, cat_cols)
    codes = F.array(*[F.col(f"_code{i}") for i in range(len(cat_cols))], F.col("_med") * F.col("_med") / 2)
    coded = coded.withColumn("_mixed", F.concat("_num", codes))
    # One neighbour search serves both the interpolation and the categorical vote.
    nn = minority_neighbours(coded.select("_id", "_y", "_mixed"), "_y", "_id", "_mixed", k, seed, n_cat=len(cat_cols))
    made = smote(df.select(id_col, label, num_vec), label, id_col, num_vec, k=k, seed=seed, neighbours=nn, keep_originals=False)
    votes = nn.join(minority.select(F.col("_id").alias("nid"), *cat_cols), on="nid").groupBy(F.col("qid").alias("base_id")).agg(
        *[F.collect_list(c).alias(c) for c in cat_cols])
    votes = votes.select("base_id", *[_most_frequent(F.col(c)).alias(c) for c in cat_cols])
    made = made.join(votes, "base_id", "left")
    kept = df.select(F.col(label), F.col(id_col).cast("string").alias("id"), F.col(num_vec).cast("array<double>").alias(num_vec), *cat_cols)
    return kept.unionByName(made, allowMissingColumns=True)


def tomek_links(df: DataFrame, label: str, id_col: str, vec: str, seed: int = 42) -> DataFrame:
    """Pairs of mutual nearest neighbours with different labels ``(a_id, b_id, a_y, b_y)``."""
    nn = knn(df, df, 1, id_col, id_col, vec, exclude_self=True, seed=seed)
    return mutual_pairs(cut_lineage(nn), df, id_col, label)


def tomek(df: DataFrame, label: str, id_col: str, vec: str, seed: int = 42) -> DataFrame:
    """Drop rows that sit in a Tomek link, except rows of the minority class ('not minority')."""
    sizes = class_sizes(df, label)
    minority = min(sizes, key=lambda c: (sizes[c], c))
    links = tomek_links(df, label, id_col, vec, seed)
    drop = links.where(F.col("a_y") != F.lit(minority)).select(F.col("a_id").alias(id_col)).distinct()
    return df.join(drop, on=id_col, how="left_anti")
