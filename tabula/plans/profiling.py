"""Profiling and cleaning queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabula.operators import profile as P
from tabula.operators.clean import (
    clean_non_finite, derive_features, drop_incomplete, null_profile, range_violation_counts,
)
from tabula.plans import sqltext as S
from tabula.plans.fixtures import LINEITEM_NUMERIC, ORDERS_LABELLED_SQL, lineitem_features, orders_labelled
from tabula.plans.registry import register

NUM = LINEITEM_NUMERIC


def lineitem_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with missing values injected by rule: ``l_discount`` NULL on line 1,
    ``l_tax`` NaN on line 2 (cleaned to NULL by X3)."""
    li = lineitem_features(spark, sf_dir)
    li = (li.withColumn("l_discount", F.when(F.col("l_linenumber") == 1, F.lit(None).cast("double"))
                        .otherwise(F.col("l_discount")))
          .withColumn("l_tax", F.when(F.col("l_linenumber") == 2, F.lit(float("nan")))
                      .otherwise(F.col("l_tax"))))
    return clean_non_finite(li, NUM)


LI_GAPS_SQL = """
    SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice,
           CASE WHEN l_linenumber = 1 THEN NULL ELSE l_discount END AS l_discount,
           CASE WHEN l_linenumber = 2 THEN NULL ELSE l_tax END AS l_tax,
           l_returnflag, l_linestatus, l_shipdate
    FROM lineitem
"""
LONG_SQL = f"(UNPIVOT ({LI_GAPS_SQL}) ON {', '.join(NUM)} INTO NAME feature VALUE x)"


def _sig(expr: str, digits: int = 10) -> str:
    return f"CAST(printf('%.{digits - 1}e', {expr}) AS DOUBLE)"


@register("class_counts", f"SELECT label, count(*) AS n_rows FROM ({ORDERS_LABELLED_SQL}) GROUP BY label")
def q_class_counts(spark, sf_dir):
    return P.class_counts(orders_labelled(spark, sf_dir), "label")


@register("class_proportions", f"""
    SELECT label, n_rows, CAST(n_rows AS DOUBLE) / CAST(sum(n_rows) OVER () AS DOUBLE) AS share
    FROM (SELECT label, count(*) AS n_rows FROM ({ORDERS_LABELLED_SQL}) GROUP BY label)
""")
def q_class_proportions(spark, sf_dir):
    return P.class_proportions(orders_labelled(spark, sf_dir), "label")


@register("distinct_classes", "SELECT DISTINCT l_returnflag FROM lineitem")
def q_distinct_classes(spark, sf_dir):
    return P.distinct_classes(lineitem_features(spark, sf_dir), "l_returnflag")


@register("describe_lineitem", f"""
    SELECT feature, count(x) AS count, {_sig('avg(x)')} AS mean, {_sig('stddev_samp(x)')} AS std,
           min(x) AS min, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
           quantile_cont(x, 0.75) AS q3, max(x) AS max
    FROM {LONG_SQL} GROUP BY feature
""")
def q_describe(spark, sf_dir):
    return P.describe(lineitem_gaps(spark, sf_dir), NUM)


@register("histogram_lineitem", f"""
    WITH long AS (SELECT feature, x FROM {LONG_SQL}),
    rng AS (SELECT feature, min(x) AS lo, max(x) AS hi, (max(x) - min(x)) / {S.dbl(30)} AS w
            FROM long GROUP BY feature),
    binned AS (SELECT l.feature, CAST(CASE WHEN r.w > 0 THEN least(floor((l.x - r.lo) / r.w), 29) ELSE 0 END
                                      AS INTEGER) AS bin
               FROM long l JOIN rng r USING (feature)),
    counts AS (SELECT feature, bin, count(*) AS n_rows FROM binned GROUP BY feature, bin),
    grid AS (SELECT feature, lo, w, CAST(unnest(range(0, 30)) AS INTEGER) AS bin FROM rng)
    SELECT g.feature, g.bin, g.lo + g.bin * g.w AS lo_edge, g.lo + (g.bin + 1) * g.w AS hi_edge,
           coalesce(c.n_rows, 0) AS n_rows
    FROM grid g LEFT JOIN counts c USING (feature, bin)
""")
def q_histogram(spark, sf_dir):
    return P.histogram(lineitem_gaps(spark, sf_dir), NUM)


@register("box_stats_lineitem", f"""
    WITH long AS (SELECT l_returnflag, feature, x FROM {LONG_SQL}),
    q AS (SELECT l_returnflag, feature, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
                 quantile_cont(x, 0.75) AS q3 FROM long GROUP BY l_returnflag, feature),
    f AS (SELECT *, q3 - q1 AS iqr, q1 - {S.dbl(1.5)} * (q3 - q1) AS lo_fence,
                 q3 + {S.dbl(1.5)} * (q3 - q1) AS hi_fence FROM q)
    SELECT l_returnflag, feature, q1, median, q3, iqr,
           min(CASE WHEN x >= lo_fence AND x <= hi_fence THEN x END) AS whisker_lo,
           max(CASE WHEN x >= lo_fence AND x <= hi_fence THEN x END) AS whisker_hi,
           count(*) FILTER (WHERE NOT (x >= lo_fence AND x <= hi_fence)) AS n_fliers
    FROM long JOIN f USING (l_returnflag, feature)
    GROUP BY l_returnflag, feature, q1, median, q3, iqr
""")
def q_box_stats(spark, sf_dir):
    return P.box_stats(lineitem_gaps(spark, sf_dir), NUM, "l_returnflag")


_IQR_BOUNDS_SQL = f"""
    q AS (SELECT feature, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3
          FROM {LONG_SQL} GROUP BY feature),
    b AS (SELECT feature, q1 - {S.dbl(1.5)} * (q3 - q1) AS lo, q3 + {S.dbl(1.5)} * (q3 - q1) AS hi FROM q)
"""


@register("iqr_outliers", f"""
    WITH {_IQR_BOUNDS_SQL},
    long AS (SELECT feature, x FROM {LONG_SQL}),
    n AS (SELECT count(*) AS n FROM lineitem),
    o AS (SELECT b.feature, count(l.x) FILTER (WHERE l.x < b.lo OR l.x > b.hi) AS n_outliers
          FROM b LEFT JOIN long l USING (feature) GROUP BY b.feature)
    SELECT feature, n_outliers, {S.rnd('CAST(n_outliers AS DOUBLE) * 100.0 / CAST(n AS DOUBLE)', 2)} AS pct
    FROM o, n
""")
def q_iqr_outliers(spark, sf_dir):
    return P.iqr_outliers(lineitem_gaps(spark, sf_dir), NUM)


@register("iqr_filter", f"""
    WITH {_IQR_BOUNDS_SQL},
    li AS ({LI_GAPS_SQL}),
    bw AS (SELECT {', '.join(f"max(CASE WHEN feature = '{c}' THEN lo END) AS {c}_lo, max(CASE WHEN feature = '{c}' THEN hi END) AS {c}_hi" for c in NUM)} FROM b)
    SELECT li.l_orderkey, li.l_linenumber, {', '.join('li.' + c for c in NUM)}
    FROM li, bw
    WHERE {' AND '.join(f'(li.{c} IS NULL OR li.{c} BETWEEN bw.{c}_lo AND bw.{c}_hi)' for c in NUM)}
""")
def q_iqr_filter(spark, sf_dir):
    li = lineitem_gaps(spark, sf_dir)
    return P.iqr_filter(li, NUM).select("l_orderkey", "l_linenumber", *NUM)


_PAIRS = [(a, b) for i, a in enumerate(NUM) for j, b in enumerate(NUM) if j < i]


@register("correlation_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, {_sig(f'corr({a}, {b})', 9)} AS corr FROM ({LI_GAPS_SQL})"
    for a, b in _PAIRS))
def q_correlation_matrix(spark, sf_dir):
    return P.correlation_matrix(lineitem_gaps(spark, sf_dir), NUM)


@register("target_correlation", "SELECT *, row_number() OVER (ORDER BY abs(corr) DESC, feature)::INT AS rank FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {_sig(f'corr({c}, CAST(l_linestatus = ' + chr(39) + 'F' + chr(39) + ' AS INTEGER))', 9)}"
    f" AS corr FROM ({LI_GAPS_SQL})" for c in NUM) + ")")
def q_target_correlation(spark, sf_dir):
    li = lineitem_gaps(spark, sf_dir).withColumn("target", (F.col("l_linestatus") == "F").cast("int"))
    ranked = Window.orderBy(F.abs("corr").desc(), "feature")  # one row per feature
    return P.target_correlation(li, NUM, "target").withColumn("rank", F.row_number().over(ranked))


_GAP_COLS = [("l_orderkey", "bigint"), ("l_linenumber", "int"), ("l_quantity", "double"),
             ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
             ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")]


@register("null_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, '{t}' AS dtype, count(*) FILTER (WHERE {c} IS NULL) AS n_null, {i} AS position "
    f"FROM ({LI_GAPS_SQL})" for i, (c, t) in enumerate(_GAP_COLS)))
def q_null_profile(spark, sf_dir):
    return null_profile(lineitem_gaps(spark, sf_dir))


@register("drop_incomplete", f"""
    SELECT l_orderkey, l_linenumber, {', '.join(NUM)} FROM ({LI_GAPS_SQL})
    WHERE {' AND '.join(f'{c} IS NOT NULL' for c in NUM)}
""")
def q_drop_incomplete(spark, sf_dir):
    return drop_incomplete(lineitem_gaps(spark, sf_dir), NUM).select("l_orderkey", "l_linenumber", *NUM)


@register("shape_orders", f"SELECT count(*) AS n_rows, (SELECT count(*)::INT FROM (DESCRIBE {ORDERS_LABELLED_SQL})) AS n_cols FROM ({ORDERS_LABELLED_SQL})")
def q_shape(spark, sf_dir):
    return P.shape(orders_labelled(spark, sf_dir))


# Fixed parameters of the range check on lineitem (stand-ins for slider bounds).
LINEITEM_BOUNDS = {"l_quantity": (5.0, 45.0), "l_discount": (0.01, 0.09), "l_tax": (0.0, 0.07)}


@register("range_violations", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {S.dbl(lo)} AS lo, {S.dbl(hi)} AS hi, "
    f"count(*) FILTER (WHERE {c} < {S.dbl(lo)}) AS n_below, count(*) FILTER (WHERE {c} > {S.dbl(hi)}) AS n_above, "
    f"count(*) AS n_rows FROM ({LI_GAPS_SQL})" for c, (lo, hi) in LINEITEM_BOUNDS.items()))
def q_range_violations(spark, sf_dir):
    return range_violation_counts(lineitem_gaps(spark, sf_dir), LINEITEM_BOUNDS)


# Fixed parameters of the derived-feature example (guarded log, ratio with offset, mean, flag).
DERIVED = {
    "log_price": ("log", "l_extendedprice", 1e-6),
    "tax_per_discount": ("ratio", "l_tax", "l_discount", 0.01),
    "mean_rate": ("mean", "l_discount", "l_tax"),
    "bulk": ("flag", "l_quantity", ">=", 25.0),
}


@register("derived_features", f"""
    SELECT l_orderkey, l_linenumber,
           {_sig(f'ln(greatest(l_extendedprice, {S.dbl(1e-6)}))', 10)} AS log_price,
           l_tax / (l_discount + {S.dbl(0.01)}) AS tax_per_discount,
           (l_discount + l_tax) / {S.dbl(2.0)} AS mean_rate,
           CASE WHEN l_quantity >= {S.dbl(25.0)} THEN 1.0 ELSE 0.0 END::DOUBLE AS bulk
    FROM ({LI_GAPS_SQL})
""")
def q_derived_features(spark, sf_dir):
    out = derive_features(lineitem_gaps(spark, sf_dir), DERIVED)
    return out.select("l_orderkey", "l_linenumber", P.sig(F.col("log_price"), 10).alias("log_price"),
                      "tax_per_discount", "mean_rate", "bulk")


@register("range_flags", f"""
    SELECT l_orderkey, l_linenumber,
           {', '.join(f"coalesce({c} < {S.dbl(lo)} OR {c} > {S.dbl(hi)}, false) AS {c}_out" for c, (lo, hi) in LINEITEM_BOUNDS.items())},
           {' + '.join(f"CAST(coalesce({c} < {S.dbl(lo)} OR {c} > {S.dbl(hi)}, false) AS INTEGER)" for c, (lo, hi) in LINEITEM_BOUNDS.items())}
             AS n_violations
    FROM ({LI_GAPS_SQL})
""")
def q_range_flags(spark, sf_dir):
    """X22 per row: which inputs fall outside their bounds (NULL is not a violation)."""
    from tabula.operators.clean import range_violations
    out = range_violations(lineitem_gaps(spark, sf_dir), LINEITEM_BOUNDS)
    return out.select("l_orderkey", "l_linenumber", *[f"{c}_out" for c in LINEITEM_BOUNDS], "n_violations")
