"""Sinks (K1-K3, K7-K9) and the idempotent append.

Writers never collect.  ``append_keyed`` adds only rows with new keys, at a cost that follows the
batch; ``append_table`` does so for tables of any layout, with a shuffle of the target's keys.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabula.session import cut_lineage


# ── K1 / K2 ─────────────────────────────────────────────────────────────────
def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "overwrite") -> str:
    """CSV with a header and no index column."""
    df.write.mode(mode).option("header", True).option("sep", sep).csv(path)
    return path


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> str:
    """Parquet, optionally partitioned (e.g. by ``split``) so readers prune directories."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


# ── K3 / J5 ─────────────────────────────────────────────────────────────────
def new_rows(batch: DataFrame, target: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``batch`` whose key is not in ``target`` (left anti join on the key)."""
    return batch.join(target.select(*key).distinct(), on=key, how="left_anti")


def append_table(spark: SparkSession, batch: DataFrame, path: str, key: list[str] | None = None,
                 fmt: str = "parquet") -> int:
    """Append ``batch`` to the table at ``path``, creating it from the batch schema if absent.

    With ``key`` the append is idempotent: keys already present are skipped
    (the upsert-by-insert the batch loader intends).  Returns rows written.
    """
    try:
        target = spark.read.format(fmt).load(path)
        exists = True
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        exists = False  # created by this write
    rows = new_rows(batch, target, key) if (exists and key) else batch
    if key:  # of different rows with one key, always the same one
        whole = F.struct(*rows.columns)
        rows = rows.groupBy(*key).agg(F.min_by(whole, F.to_json(whole)).alias("_row")).select("_row.*")
    rows = rows.cache()
    n = rows.count()
    if n or not exists:
        rows.write.mode("append").format(fmt).save(path)
    rows.unpersist()
    return n


# Folders that the keys of a keyed table are dealt over, and bytes of batch keys that are broadcast at once.
KEY_BUCKETS = 32
KEY_SLICE_BYTES = 32 << 20
BUCKET = "key_bucket"


def append_keyed(spark: SparkSession, batch: DataFrame, path: str, key: list[str], buckets: int = KEY_BUCKETS) -> int:
    """Append the rows of ``batch`` whose key the table at ``path`` does not have; returns the rows written.

    The table is laid out in ``buckets`` folders by the hash of the key.  The keys of the batch, measured and cut
    into slices of at most ``KEY_SLICE_BYTES`` along those folders, are broadcast into a scan of the slice's folders
    (key columns only) that keeps the keys that are there already.  So the log is never shuffled: what moves
    depends on the batch, each touched folder is scanned once, and untouched ones are not read.

    Of different batch rows with one key, always the same one is taken; NULL is a key like any other.
    """
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    whole = F.struct(*batch.columns)
    rows = batch.groupBy(*key).agg(F.min_by(whole, F.to_json(whole)).alias("_row")).select("_row.*")
    rows = cut_lineage(rows.withColumn(BUCKET, bucket))
    try:
        target = spark.read.parquet(path).select(*key, BUCKET)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        target = None  # created by this write
    if target is not None:
        rows = rows.join(cut_lineage(_present(rows, target, key)), _same(key, rows), "left_anti")
        rows = cut_lineage(rows)
    rows.repartition(buckets, BUCKET).write.mode("append").partitionBy(BUCKET).parquet(path)
    return rows.count()


def _same(key: list[str], left: DataFrame):
    match = F.lit(True)
    for c in key:
        match = match & left[c].eqNullSafe(F.col(f"_k_{c}"))
    return match


def _present(rows: DataFrame, target: DataFrame, key: list[str]) -> DataFrame:
    """Keys (``_k_...``) of ``rows`` that ``target`` has: a broadcast semi join into each slice's folders."""
    keys = rows.select(*[F.col(c).alias(f"_k_{c}") for c in key], F.col(BUCKET).alias("_b"))
    width = sum((F.coalesce(F.octet_length(F.col(f"_k_{c}").cast("string")), F.lit(0)) + 32 for c in key), F.lit(0))
    sizes = sorted((r["_b"], r["bytes"]) for r in keys.groupBy("_b").agg(F.sum(width).alias("bytes")).collect())  # one row per folder
    slices, held = [], KEY_SLICE_BYTES + 1
    for b, size in sizes:
        if held + size > KEY_SLICE_BYTES:
            slices.append([])
            held = 0
        slices[-1].append((b, size))
        held += size
    out = keys.drop("_b").limit(0)
    for part in slices:
        names, size = [b for b, _ in part], sum(s for _, s in part)
        parts = max(1, -(-size // KEY_SLICE_BYTES))  # a folder of more keys than a slice is scanned in parts
        for i in range(parts):
            some = keys.where(F.col("_b").isin(names)).drop("_b").where(F.pmod(F.xxhash64(*[f"_k_{c}" for c in key], F.lit(1)), F.lit(parts)) == i)
            found = target.where(F.col(BUCKET).isin(names)).select(*key)
            found = found.join(F.broadcast(some), _same(key, found), "left_semi")
            out = out.unionByName(found.select(*[F.col(c).alias(f"_k_{c}") for c in key]))
    return out


def jdbc_write_options(url: str, table: str, batch_size: int = 500, user: str | None = None,
                       password: str | None = None) -> dict[str, str]:
    """Options for ``df.write.format('jdbc')`` with 500-row batches (no driver or network here)."""
    opts = {"url": url, "dbtable": table, "batchsize": str(batch_size)}
    if user is not None:
        opts["user"] = user
    if password is not None:
        opts["password"] = password
    return opts


# ── K7 ──────────────────────────────────────────────────────────────────────
# Fixed schema of the prediction log (numeric features as double, elapsed nullable).
PREDICTION_LOG_FEATURES = ["fixed_acidity", "volatile_acidity", "citric_acid", "residual_sugar", "chlorides",
                           "free_sulfur_dioxide", "total_sulfur_dioxide", "density", "ph", "sulphates", "alcohol"]


def prediction_log_schema(features: list[str] | None = None) -> T.StructType:
    feats = PREDICTION_LOG_FEATURES if features is None else features
    return T.StructType(
        [T.StructField("id", T.StringType(), False), T.StructField("created_at", T.TimestampNTZType(), False)]
        + [T.StructField(f, T.DoubleType(), True) for f in feats]
        + [T.StructField("wine_type", T.StringType(), True),
           T.StructField("predicted_quality", T.ShortType(), False),
           T.StructField("quality_label", T.StringType(), False),
           T.StructField("prob_not_good", T.DoubleType(), False),
           T.StructField("prob_good", T.DoubleType(), False),
           T.StructField("elapsed_ms", T.DoubleType(), True)])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project and cast ``df`` onto ``schema`` (missing nullable columns become NULL)."""
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        elif f.nullable:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
        else:
            raise ValueError(f"missing required column {f.name}")
    return df.select(*cols)


def append_predictions(spark: SparkSession, rows: DataFrame, path: str, schema: T.StructType) -> int:
    """Append scored rows to the prediction log, idempotent on ``id``."""
    return append_table(spark, conform(rows, schema), path, key=["id"])


# ── K8 ──────────────────────────────────────────────────────────────────────
def write_report(long: DataFrame, path: str) -> str:
    """``(run, metric, value)`` → one JSON object ``{run: {metric: value}}``.

    The long table is grouped into one map per run on the executors; only the
    final object (runs × metrics numbers) passes the driver, as it is one file.
    """
    per_run = long.groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("m"))
    doc = {r["run"]: dict(sorted(r["m"].items())) for r in per_run.orderBy("run").collect()}
    text = json.dumps(doc, indent=2)
    long.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path
