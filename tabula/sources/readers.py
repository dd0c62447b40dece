"""Scans (R1-R10).

Every reader returns a lazy DataFrame; projection and filters applied later
reach the Parquet / JDBC scan through Catalyst.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabula.operators.ranking import running_totals


# ── R4 ──────────────────────────────────────────────────────────────────────
def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """One driver table (``<sf_dir>/<name>.parquet``), optionally projected at the scan."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


# ── R1 / R2 ─────────────────────────────────────────────────────────────────
def read_csv_auto(spark: SparkSession, path: str, schema: T.StructType | None = None,
                  seps: tuple[str, ...] = (";", ","), infer: bool = True) -> DataFrame:
    """CSV with a header, separator ``;`` first and ``,`` if that yields one column.

    The probe reads only the header line (``limit(1)`` on an untyped scan).
    With ``schema`` no inference pass runs; otherwise ``inferSchema`` (R2).
    """
    chosen = seps[-1]
    for sep in seps:
        probe = spark.read.option("header", True).option("sep", sep).csv(path).limit(1)
        if len(probe.columns) > 1:
            chosen = sep
            break
    reader = spark.read.option("header", True).option("sep", chosen)
    if schema is not None:
        reader = reader.schema(schema)
    elif infer:
        reader = reader.option("inferSchema", True)
    return reader.csv(path)


# ── R5 ──────────────────────────────────────────────────────────────────────
def jdbc_options(url: str, table: str, columns: list[str] | None = None, where: str | None = None,
                 partition_column: str | None = None, lower: int | None = None, upper: int | None = None,
                 num_partitions: int = 64, fetch_size: int = 10_000, user: str | None = None,
                 password: str | None = None) -> dict[str, str]:
    """Options for a partitioned, projected, filtered JDBC read.

    The projection and predicate go into a subquery so the database does the
    work; ``partitionColumn`` splits the read across executors.
    """
    cols = ", ".join(f'"{c}"' for c in columns) if columns else "*"
    query = f"(SELECT {cols} FROM {table}" + (f" WHERE {where}" if where else "") + ") AS src"
    opts = {"url": url, "dbtable": query, "fetchsize": str(fetch_size)}
    if partition_column is not None:
        if lower is None or upper is None:
            raise ValueError("partitioned JDBC read needs lower and upper bounds")
        opts.update(partitionColumn=partition_column, lowerBound=str(lower), upperBound=str(upper),
                    numPartitions=str(num_partitions))
    if user is not None:
        opts["user"] = user
    if password is not None:
        opts["password"] = password
    return opts


def read_jdbc(spark: SparkSession, **kwargs) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(**kwargs)).load()


# ── R6 ──────────────────────────────────────────────────────────────────────
def read_range(df: DataFrame, key: str, after=None, n: int = 1000) -> DataFrame:
    """One page of a keyset scan: rows with ``key > after`` in key order, at most ``n``."""
    page = df if after is None else df.filter(F.col(key) > F.lit(after))
    return page.orderBy(F.col(key).asc()).limit(n)


def read_pages(df: DataFrame, key: str, n: int = 1000) -> Iterator[DataFrame]:
    """All pages of a keyset scan, in key order, until a short one.

    Keys must be unique; rows without a key have no place in the order and are on no page."""
    df, after = df.filter(F.col(key).isNotNull()), None
    while True:
        page = read_range(df, key, after, n)
        size, last = page.agg(F.count(F.lit(1)), F.max(key)).first()
        if size:
            yield page
        if size < n:
            return
        after = last


def with_pages(df: DataFrame, key: str, n: int = 1000, out: str = "page") -> DataFrame:
    """Every row with a key plus the number (from 0) of the page that :func:`read_pages` has it on.

    One range sort for all pages: the place of a row is its place in its key range plus the rows of the
    ranges before, so nothing is sorted in one task and no page is a job of its own."""
    rows = df.filter(F.col(key).isNotNull())
    placed = running_totals(rows.withColumn("_one", F.lit(1).cast("long")), key, ["_one"])
    return placed.select(*df.columns, F.expr(f"(cum__one - 1) div {int(n)}").alias(out))


# ── R9 ──────────────────────────────────────────────────────────────────────
def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A JSON report ``{run: {metric: value}}`` as the long table ``(run, metric, value)``; runs are rows throughout."""
    raw = spark.read.text(path, wholetext=True)
    runs = F.from_json("value", T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType())))
    return raw.select(F.explode(runs).alias("run", "m")).select("run", F.explode("m").alias("metric", "value"))


# ── R10 ─────────────────────────────────────────────────────────────────────
def run_history(metrics: DataFrame, prefix: str = "val_") -> DataFrame:
    """Keep metrics named ``<prefix>*`` and pivot to one row per run.

    The metric names become columns, so they are taken from the data after
    the filter.
    """
    kept = metrics.filter(F.startswith(F.col("metric"), F.lit(prefix)))
    names = [r["metric"] for r in kept.select("metric").distinct().orderBy("metric").collect()]
    if not names:
        return kept.select("run").distinct()
    return kept.groupBy("run").pivot("metric", names).agg(F.first("value"))
