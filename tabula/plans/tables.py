"""Source, sink and schema queries (R1, R2, R6, R7, K1-K3, X1, X2, X4, X13, X27 alerts)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabula.operators.clean import normalize_columns, split_target, typed_projection, unify_schema
from tabula.operators.split import stratified_split
from tabula.plans.fixtures import ORDERS_LABELLED_SQL, SEED, orders_labelled, orders_split_sql
from tabula.plans.registry import register
from tabula.session import scratch_path
from tabula.sources.readers import read_csv_auto, read_range, read_table
from tabula.sources.sinks import BUCKET, append_keyed, write_csv, write_parquet

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


@register("table_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES))
def q_table_counts(spark, sf_dir):
    """Exact row count of every table (one job per table, each a metadata-assisted count)."""
    counts = [read_table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("n_rows"))
              .select(F.lit(t).alias("table_name"), "n_rows") for t in TABLES]
    return reduce(DataFrame.unionByName, counts)


@register("keyset_page", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey > 1000 "
                         "ORDER BY o_orderkey LIMIT 1000")
def q_keyset_page(spark, sf_dir):
    """One 1000-row page after key 1000 (the page size is the feature)."""
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_orderstatus", "o_totalprice"])
    return read_range(o, "o_orderkey", after=1000, n=1000)


@register("csv_roundtrip", f"""
    SELECT o_orderkey, o_orderstatus, o_totalprice, label FROM ({ORDERS_LABELLED_SQL})
""")
def q_csv_roundtrip(spark, sf_dir):
    """K1 → R1/R2: write ``;``-separated CSV, read back with separator probe and type inference."""
    o = orders_labelled(spark, sf_dir).select("o_orderkey", "o_orderstatus", "o_totalprice", "label")
    path = write_csv(o, scratch_path(spark, "orders_csv"), sep=";")
    back = read_csv_auto(spark, path)
    return back.select(F.col("o_orderkey").cast("bigint"), F.col("o_orderstatus").cast("string"),
                       F.col("o_totalprice").cast("double"), F.col("label").cast("int"))


@register("parquet_split_roundtrip", f"""
    SELECT o_orderkey, label FROM ({orders_split_sql(SEED)}) WHERE split = 'val'
""")
def q_parquet_split_roundtrip(spark, sf_dir):
    """K2: write the split partitioned by ``split``; read one split back (directory pruning)."""
    s = stratified_split(orders_labelled(spark, sf_dir), "label", "o_orderkey", seed=SEED)
    path = write_parquet(s.select("o_orderkey", "label", "split"), scratch_path(spark, "orders_split"),
                         partition_by=["split"])
    return spark.read.parquet(path).where(F.col("split") == "val").select("o_orderkey", "label")


@register("idempotent_append", "SELECT o_orderkey, o_orderstatus FROM orders")
def q_idempotent_append(spark, sf_dir):
    """K3 + J5: append the finished orders, then all orders; every key lands once."""
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_orderstatus"])
    path = scratch_path(spark, "orders_table")
    append_keyed(spark, o.where(F.col("o_orderstatus") == "F"), path, key=["o_orderkey"])
    append_keyed(spark, o, path, key=["o_orderkey"])
    return spark.read.parquet(path).drop(BUCKET)


@register("normalized_columns", """
    SELECT p_partkey AS p_partkey, p_name AS p_name, p_brand AS p_brand, p_retailprice AS retail_price FROM part
""")
def q_normalized_columns(spark, sf_dir):
    """Messy names (blanks, case) normalised, plus a rename map."""
    p = read_table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_brand", "p_retailprice"])
    messy = p.toDF(" P_Partkey", "P_NAME ", " p_Brand", "P RetailPrice")
    return normalize_columns(messy, rename={"p_retailprice": "retail_price"})


@register("unified_schema", """
    SELECT c_custkey AS custkey, c_acctbal AS acctbal, c_mktsegment AS segment, 'a' AS layout FROM customer
    UNION ALL
    SELECT c_custkey, c_acctbal, NULL, 'b' FROM customer
""")
def q_unified_schema(spark, sf_dir):
    """Two source layouts (different names; the second lacks the segment) onto one schema."""
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_acctbal", "c_mktsegment"])
    layout_a = c.toDF("Customer Key", "Acct Bal", "segment")
    layout_b = c.select("c_custkey", "c_acctbal").toDF("custkey", "account_balance")
    aliases = {"custkey": ["custkey", "Customer Key"], "acctbal": ["acctbal", "account_balance", "Acct Bal"]}
    a = unify_schema(layout_a, aliases, optional={"segment": "string"}).withColumn("layout", F.lit("a"))
    b = unify_schema(layout_b, aliases, optional={"segment": "string"}).withColumn("layout", F.lit("b"))
    return a.unionByName(b)


@register("typed_projection", """
    SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_quantity AS INTEGER) AS l_quantity,
           CAST(l_extendedprice AS DOUBLE) AS l_extendedprice, CAST(l_shipdate AS DATE) AS ship_date
    FROM lineitem
""")
def q_typed_projection(spark, sf_dir):
    """Casts to declared types; columns not listed are dropped."""
    li = read_table(spark, sf_dir, "lineitem")
    return typed_projection(li, {"l_orderkey": "string", "l_quantity": "int", "l_extendedprice": "double",
                                 "ship_date": F.col("l_shipdate").cast("date")})


@register("target_split", f"SELECT CAST(label AS INTEGER) AS label FROM ({ORDERS_LABELLED_SQL})")
def q_target_split(spark, sf_dir):
    """The target as int (the feature frame is the same rows without it)."""
    _, y = split_target(orders_labelled(spark, sf_dir).drop("grade"), "label")
    return y
