"""Driver tables shaped as classification inputs.

The library is generic over column names; these functions only pick which
driver-table columns play the roles of features, category, label and row key
(see FIXTURES.md §C), and the matching DuckDB text for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabula.operators.clean import binarize_label, clean_non_finite, filter_labelled
from tabula.plans import sqltext as S
from tabula.sources.readers import read_table

# Fixed parameters of the orders fixture: price scaled to a 0-10 grade, cut at 7.
GRADE_SCALE = 50000.0
GRADE_THRESHOLD = 7
SEED = 42
STATUS_LEVELS = ["F", "O", "P"]


def orders_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders → NaN/inf cleaned → grade → label, NULL grades dropped."""
    o = read_table(spark, sf_dir, "orders",
                   ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"])
    # A plain NULL test reaches the Parquet scan; the NaN/inf cleaning below cannot.
    o = o.where(F.col("o_totalprice").isNotNull())
    o = clean_non_finite(o, ["o_totalprice"])
    o = o.withColumn("grade", F.col("o_totalprice") / F.lit(GRADE_SCALE))
    o = filter_labelled(o, "grade")
    return binarize_label(o, "grade", "label", GRADE_THRESHOLD)


ORDERS_LABELLED_SQL = f"""
    SELECT o_orderkey, o_custkey, o_orderstatus, {S.finite('o_totalprice')} AS o_totalprice,
           o_orderdate, o_orderpriority,
           {S.finite('o_totalprice')} / {S.dbl(GRADE_SCALE)} AS grade,
           {S.binarize(S.finite('o_totalprice') + ' / ' + S.dbl(GRADE_SCALE), GRADE_THRESHOLD)} AS label
    FROM orders
    WHERE {S.finite('o_totalprice')} IS NOT NULL
"""


def split_sql(base_sql: str, label: str, key: str, seed: int = SEED) -> str:
    """Oracle of S1: a plain window per class (fine for a check), same cuts as the library."""
    return f"""
    WITH base AS ({base_sql}),
    hashed AS (SELECT *, {S.h32(seed, key)} AS _h FROM base),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY _h, {key}) - 1 AS _r,
               count(*) OVER (PARTITION BY {label}) AS _n
        FROM hashed),
    cut AS (SELECT *, CAST(ceil({S.dbl(0.2)} * _n) AS BIGINT) AS _n_test FROM ranked),
    cut2 AS (SELECT *, _n_test + CAST(ceil({S.dbl(0.25)} * (_n - _n_test)) AS BIGINT) AS _n_tv FROM cut)
    SELECT * EXCLUDE (_h, _r, _n, _n_test, _n_tv),
           CASE WHEN _r < _n_test THEN 'test' WHEN _r < _n_tv THEN 'val' ELSE 'train' END AS split
    FROM cut2
    """


def orders_split_sql(seed: int = SEED) -> str:
    return split_sql(ORDERS_LABELLED_SQL, "label", "o_orderkey", seed)


def lineitem_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four numeric lineitem columns plus flags; no NULLs in the driver data."""
    return read_table(spark, sf_dir, "lineitem",
                      ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                       "l_returnflag", "l_linestatus", "l_shipdate"])


LINEITEM_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
