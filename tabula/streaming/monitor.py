"""Rolling monitoring of the prediction log (ST2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rolling_counts(scored: DataFrame, window: str = "1 hour", ts: str = "created_at",
                   watermark: str | None = None) -> DataFrame:
    """Predictions and mean confidence per tumbling ``window`` and predicted class.

    Batch and stream share this plan; on a stream pass ``watermark`` (e.g.
    ``'10 minutes'``) so state for closed windows is dropped and rows later
    than the watermark are ignored.
    """
    ts_type = scored.schema[ts].dataType
    src = scored
    if watermark:
        # Watermarks need an instant-typed event time; windows are cast back so the
        # stream and the batch form share one schema.
        src = scored.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    g = src.groupBy(F.window(F.col(ts), window).alias("w"), "predicted_quality").agg(
        F.count(F.lit(1)).alias("n_predictions"), F.avg("confidence").alias("mean_confidence"))
    return g.select(F.col("w.start").cast(ts_type).alias("window_start"),
                    F.col("w.end").cast(ts_type).alias("window_end"),
                    "predicted_quality", "n_predictions", "mean_confidence")


def run_monitor_stream(scored: DataFrame, out_path: str, checkpoint: str, window: str = "1 hour", ts: str = "created_at",
                       delay: str = "10 minutes") -> str:
    """:func:`rolling_counts` of a stream, every closed window written once (append mode); returns ``out_path``.

    A window is closed when the watermark, the latest event time of the batches before less ``delay``, has passed
    its end; rows of closed windows are dropped as too late.  State and watermark live in ``checkpoint``: run again,
    the stream goes on with the open windows of the run before.  The file sink commits each epoch once."""
    q = (rolling_counts(scored, window, ts, watermark=delay).writeStream.outputMode("append").format("parquet")
         .option("path", out_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return out_path
