"""Online scoring (ST1): a file stream of requests → a saved model → an exactly-once prediction log.

* The log is partitioned by stream and epoch, ``<log>/stream=<s>/epoch=<n>``, and an epoch's folder is
  overwritten.  After a failure Spark runs the last epoch again with the same offsets, so a replay writes
  the same rows to the same folder: nothing is appended twice and no old row is read.
* Requests that are delivered more than once are dropped by state: a key stays in the state store until
  ``keep`` has passed since it arrived.  The watermark is on the time of arrival, which the offset log
  fixes, so no request is too late to be scored and a replay decides alike.

The cost of an epoch is that of its own requests, however long the log is.  ``stream`` is made from the
checkpoint folder: streams with different checkpoints can share a log without touching each other's epochs.
Only a stream that starts on a log which other streams wrote (as after a lost checkpoint, when all files
come again) looks its ids up in their folders and leaves out what is there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabula.operators.ranking import small_side
from tabula.session import cut_lineage, scratch_path
from tabula.sources.sinks import conform, prediction_log_schema


Scorer = Callable[[DataFrame], DataFrame]
#: How long the key of a request is kept to drop repeated deliveries.
KEEP = "1 day"


def run_model_stream(spark: SparkSession, source_dir: str, schema: T.StructType, model_path: str, log_path: str,
                     checkpoint: str, features: list[str] | None = None, scorer: Scorer | None = None,
                     id_col: str = "id", keep: str = KEEP, files_per_trigger: int | None = None) -> str:
    """Score every request file of the folder ``source_dir`` that was not scored yet with a saved model.

    Run again with the same ``checkpoint``, it takes only the files that came since.  ``scorer(batch)`` makes
    log rows; by default those of the original layout, :func:`tabula.plans.stages.scored_rows`."""
    from tabula.plans.stages import scored_rows

    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader
    requests = reader.parquet(source_dir)
    return log_stream(requests, scorer or (lambda batch: scored_rows(batch, model_path)), prediction_log_schema(features), log_path,
                      checkpoint, id_col, keep)


def log_stream(requests: DataFrame, scorer: Scorer, schema: T.StructType, log_path: str, checkpoint: str, id_col: str = "id",
               keep: str = KEEP) -> str:
    """Run the stream over everything available, then stop; returns the log path."""
    stream = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:12]
    once = requests.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", keep) \
        .dropDuplicatesWithinWatermark([id_col]).drop("_arrived")

    others = _other_streams(requests.sparkSession, log_path, stream)

    def sink(batch: DataFrame, epoch: int) -> None:
        rows = conform(scorer(batch), schema)
        if others:
            rows = cut_lineage(rows)
            there = batch.sparkSession.read.schema(schema).parquet(*others).select("id")
            there = there.join(small_side(rows.select("id")), "id", "left_semi").distinct()  # at most the batch's ids
            rows = rows.join(there, "id", "left_anti")
        rows.write.mode("overwrite").parquet(f"{log_path.rstrip('/')}/stream={stream}/epoch={epoch}")

    q = (once.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return log_path


def _other_streams(spark: SparkSession, log_path: str, stream: str) -> list[str]:
    top = spark._jvm.org.apache.hadoop.fs.Path(log_path)
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [x.getPath() for x in files.listStatus(top) if x.isDirectory()] if files.exists(top) else []
    return [p.toString() for p in found if p.getName().startswith("stream=") and p.getName() != f"stream={stream}"]


def read_log(spark: SparkSession, log_path: str, schema: T.StructType) -> DataFrame:
    """The rows of a prediction log, without the columns of its folders."""
    return spark.read.schema(schema).parquet(log_path).select(*schema.names)


def scoring_stream(spark: SparkSession, source_dir: str, table: str, columns: list[str]) -> DataFrame:
    """Streaming read of ``<source_dir>/<table>.parquet`` with the batch schema (no inference)."""
    schema = spark.read.parquet(f"{source_dir.rstrip('/')}/{table}.parquet").select(*columns).schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet")
            .option("maxFilesPerTrigger", 1).parquet(source_dir).select(*columns))


def written_in_turn(parts: list[DataFrame], folder: str | None = None) -> str:
    """Each frame as a file of its own in one folder, in order of their times: input for a stream of several triggers."""
    spark = parts[0].sparkSession
    folder = folder or scratch_path(spark, "stream-input")
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(folder)
    return folder
