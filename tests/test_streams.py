"""Exactly-once scoring stream, stateful monitor, keyed appends."""

import os
import shutil

from pyspark.sql import functions as F

from conftest import SF_SMALL
from tabula.plans import scoring as P
from tabula.sources import sinks
from tabula.sources.sinks import BUCKET, append_keyed, prediction_log_schema
from tabula.streaming.scoring import log_stream, read_log, written_in_turn

LOG = prediction_log_schema(["value"])


def rows_of(spark, log):
    return sorted(tuple(r) for r in read_log(spark, log, LOG).collect())


def run(spark, folder, schema, log, checkpoint):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    log_stream(stream, P.score_requests, LOG, log, checkpoint, "event_id")


def test_a_replayed_epoch_changes_nothing(spark, tmp_path):
    base = str(tmp_path)
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet").select(*P.EVENT_COLS)
    folder = written_in_turn([events.where("event_id % 3 = 0"), events.where("event_id % 3 = 1"), events.where("event_id % 3 = 1 or event_id % 3 = 2")], f"{base}/in")
    run(spark, folder, events.schema, f"{base}/log", f"{base}/cp")
    want = sorted(tuple(r) for r in sinks.conform(P.score_requests(events), LOG).collect())
    assert rows_of(spark, f"{base}/log") == want  # the third file repeats the second: state dropped it
    before = {d: sorted(os.listdir(f"{base}/log/{s}/{d}")) for s in os.listdir(f"{base}/log") if s.startswith("stream") for d in os.listdir(f"{base}/log/{s}")}
    assert len(before) >= 3
    # as after a crash between the write and the commit of the last epoch: the same checkpoint without that commit
    commits = [c for c in os.listdir(f"{base}/cp/commits") if c.isdigit()]
    last = max(commits, key=int)
    shutil.copytree(f"{base}/cp", f"{base}/saved/cp", ignore=lambda d, names: [n for n in names if d.endswith("commits") and last in n])
    os.rename(f"{base}/cp", f"{base}/cp-done")
    os.rename(f"{base}/saved/cp", f"{base}/cp")
    run(spark, folder, events.schema, f"{base}/log", f"{base}/cp")
    assert rows_of(spark, f"{base}/log") == want
    # new files only, then a stream that lost its checkpoint
    more = events.limit(7).withColumn("event_id", F.col("event_id") + 1_000_000)
    written_in_turn([more], folder)
    run(spark, folder, events.schema, f"{base}/log", f"{base}/cp")
    run(spark, folder, events.schema, f"{base}/log", f"{base}/cp-lost")
    assert len(rows_of(spark, f"{base}/log")) == len(want) + 7 == read_log(spark, f"{base}/log", LOG).select("id").distinct().count()


def test_an_epoch_reads_no_log(spark, tmp_path):
    """Without other streams in the log the batch is written as it comes."""
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet").select(*P.EVENT_COLS).limit(50)
    folder = written_in_turn([events], f"{tmp_path}/in")
    run(spark, folder, events.schema, f"{tmp_path}/log", f"{tmp_path}/cp")
    written_in_turn([events.withColumn("event_id", F.col("event_id") + 100_000)], folder)
    stream = next(s for s in os.listdir(f"{tmp_path}/log") if s.startswith("stream"))
    old = f"{tmp_path}/log/{stream}/epoch=0"
    os.rename(old, f"{tmp_path}/hidden")  # a run that read the old epoch would miss it
    run(spark, folder, events.schema, f"{tmp_path}/log", f"{tmp_path}/cp")
    os.rename(f"{tmp_path}/hidden", old)
    assert len(rows_of(spark, f"{tmp_path}/log")) == 100


def test_append_keyed(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "n"), (None, "n")], "id long, v string")
    assert append_keyed(spark, df, path, ["id"]) == 3
    first = sorted((str(r.id), r.v) for r in spark.read.parquet(path).collect())
    assert first == [("1", "a"), ("2", "b"), ("None", "n")]
    assert append_keyed(spark, df, path, ["id"]) == 0
    monkeypatch.setattr(sinks, "KEY_SLICE_BYTES", 100)  # many slices, folders of several parts
    more = spark.range(200).selectExpr("id", "cast(id as string) as v")
    assert append_keyed(spark, more, path, ["id"]) == 198
    assert append_keyed(spark, more, path, ["id"]) == 0
    assert spark.read.parquet(path).count() == 201
    assert append_keyed(spark, more.limit(0), path, ["id"]) == 0


def test_the_log_is_not_shuffled(spark, tmp_path):
    path = f"{tmp_path}/t"
    append_keyed(spark, spark.range(5000).selectExpr("id", "id as v"), path, ["id"])
    batch = spark.range(10).selectExpr("id", f"cast(pmod(xxhash64(id), {sinks.KEY_BUCKETS}) as int) as {BUCKET}")
    found = sinks._present(batch, spark.read.parquet(path).select("id", BUCKET), ["id"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and f"PartitionFilters: [{BUCKET}" in plan.replace("[isnotnull(", "[")
    assert found.count() == 10
