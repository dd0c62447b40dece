"""Registered queries: each reads the driver tables under ``sf_dir`` and returns a DataFrame.

Every entry pairs a Spark plan with, where the operator is expressible in
SQL, an independent DuckDB query over the same tables.  Column names match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from tabula.operators.clean import one_hot
from tabula.operators.split import split_sizes, stratified_split
from tabula.plans import sqltext as S
from tabula.plans.fixtures import (
    ORDERS_LABELLED_SQL, SEED, STATUS_LEVELS, orders_labelled, orders_split_sql,
)

from tabula.plans.registry import ORACLE, REGISTRY, register  # noqa: F401


# ── Minimum slice: R4 → X3 → X5 → X6 → X8 → S1 → E11 ──────────────────────
def orders_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_hot(orders_labelled(spark, sf_dir), "o_orderstatus", prefix="status")


@register("split_sizes", f"""
    WITH s AS ({orders_split_sql(SEED)}),
    c AS (SELECT split, label, count(*) AS n_rows FROM s GROUP BY split, label)
    SELECT split, label, n_rows,
           {S.rnd('CAST(n_rows AS DOUBLE) * 100.0 / CAST(sum(n_rows) OVER () AS DOUBLE)', 1)} AS pct
    FROM c
""")
def q_split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = stratified_split(orders_prepared(spark, sf_dir), "label", "o_orderkey", seed=SEED)
    return split_sizes(df, "split", "label")


@register("orders_prepared", f"""
    SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority, grade, label,
           {', '.join(f"CASE WHEN o_orderstatus = '{v}' THEN 1.0 ELSE 0.0 END::DOUBLE AS status_{v}" for v in STATUS_LEVELS)}
    FROM ({ORDERS_LABELLED_SQL})
""")
def q_orders_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_prepared(spark, sf_dir)


@register("orders_split", f"""
    SELECT o_orderkey, label, split FROM ({orders_split_sql(SEED)})
""")
def q_orders_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified_split(orders_labelled(spark, sf_dir), "label", "o_orderkey", seed=SEED) \
        .select("o_orderkey", "label", "split")


# Further query groups register themselves on import.
from tabula.plans import profiling  # noqa: E402,F401
from tabula.plans import evaluation  # noqa: E402,F401
from tabula.plans import neighbours  # noqa: E402,F401
from tabula.plans import preparation  # noqa: E402,F401
from tabula.plans import training  # noqa: E402,F401
from tabula.plans import learners  # noqa: E402,F401
from tabula.plans import scoring  # noqa: E402,F401
from tabula.plans import tables  # noqa: E402,F401
from tabula.plans import gaps  # noqa: E402,F401
from tabula.plans import boosting  # noqa: E402,F401
from tabula.plans import certificates  # noqa: E402,F401


@register("split_class_shares", f"""
    WITH s AS ({orders_split_sql(SEED)}),
    c AS (SELECT split, label, count(*) AS n_rows FROM s GROUP BY split, label)
    SELECT split, label, n_rows,
           {S.rnd('CAST(n_rows AS DOUBLE) * 100.0 / CAST(sum(n_rows) OVER (PARTITION BY split) AS DOUBLE)', 2)} AS pct_of_split,
           {S.rnd('CAST(n_rows AS DOUBLE) * 100.0 / CAST(sum(n_rows) OVER (PARTITION BY label) AS DOUBLE)', 2)} AS pct_of_class
    FROM c
""")
def q_split_class_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E11 per class: the stratification check (each class's share in each split)."""
    from tabula.operators.split import split_class_shares
    df = stratified_split(orders_labelled(spark, sf_dir), "label", "o_orderkey", seed=SEED)
    return split_class_shares(df, "split", "label")
