"""Saved = in-memory models, JDBC option builders, stream = batch, SMOTE-NC categorical vote."""

import os
import tempfile

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tabula.operators.preprocess import fitted_levels, make_preprocessor
from tabula.operators.rebalance import smote_nc
from tabula.sources.readers import jdbc_options, read_csv_auto
from tabula.sources.sinks import jdbc_write_options, write_csv


def test_saved_pipeline_scores_like_the_in_memory_one(spark):
    rows = [(i, float(i % 7), float((i * 3) % 11) if i % 5 else None, "a" if i % 2 else "b", int(i % 7 > 3))
            for i in range(200)]
    df = spark.createDataFrame(rows, "id long, x double, z double, c string, y int")
    levels = fitted_levels(df, ["c"])
    pre = make_preprocessor(["x", "z"], ["c"], cat_levels=levels)
    model = Pipeline(stages=pre.getStages() + [LogisticRegression(labelCol="y", maxIter=50)]).fit(df)
    path = os.path.join(tempfile.mkdtemp(prefix="tabula-model-"), "m")
    model.write().overwrite().save(path)
    again = PipelineModel.load(path)
    a = [r["prediction"] for r in model.transform(df).orderBy("id").collect()]
    b = [r["prediction"] for r in again.transform(df).orderBy("id").collect()]
    assert a == b


def test_jdbc_option_builders():
    o = jdbc_options("jdbc:postgresql://db/x", "wine", columns=["a", "quality"], where="quality IS NOT NULL",
                     partition_column="id", lower=0, upper=1000, num_partitions=8)
    assert o["dbtable"] == '(SELECT "a", "quality" FROM wine WHERE quality IS NOT NULL) AS src'
    assert (o["partitionColumn"], o["lowerBound"], o["upperBound"], o["numPartitions"]) == ("id", "0", "1000", "8")
    with pytest.raises(ValueError):
        jdbc_options("u", "t", partition_column="id")
    assert jdbc_write_options("u", "t")["batchsize"] == "500"


def test_csv_separator_probe(spark):
    df = spark.createDataFrame([(1, 2.5, "x")], "a int, b double, c string")
    for sep in (";", ","):
        path = write_csv(df, os.path.join(tempfile.mkdtemp(prefix="tabula-csv-"), "t"), sep=sep)
        back = read_csv_auto(spark, path)
        assert back.columns == ["a", "b", "c"] and back.collect()[0]["b"] == 2.5


def test_stream_monitor_equals_batch(spark):
    from tabula.plans.scoring import EVENT_COLS, score_requests
    from tabula.streaming.monitor import rolling_counts
    from tabula.streaming.scoring import scoring_stream

    batch = rolling_counts(score_requests(spark.read.parquet(f"{SF_SMALL}/events.parquet").select(*EVENT_COLS)))
    stream = rolling_counts(score_requests(scoring_stream(spark, SF_SMALL, "events", EVENT_COLS)),
                            watermark="10 minutes")
    name = "monitor_test"
    q = stream.writeStream.outputMode("update").format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql(f"SELECT * FROM {name}")
    # update mode may emit a window more than once; the last emission per key is the final one
    final = got.groupBy("window_start", "predicted_quality").agg(F.max("n_predictions").alias("n"))
    exp = {(r["window_start"], r["predicted_quality"]): r["n_predictions"] for r in batch.collect()}
    assert {(r["window_start"], r["predicted_quality"]): r["n"] for r in final.collect()} == exp


def test_smote_nc_takes_neighbour_majority_category(spark):
    rows = []
    for i in range(30):
        rows.append((i, 0, [float(i), 0.0], "red"))
    for i in range(30, 38):
        rows.append((i, 1, [float(i) * 10, 1.0], "white" if i % 4 else "red"))
    df = spark.createDataFrame(rows, "id long, y int, num array<double>, c string")
    out = smote_nc(df, "y", "id", "num", ["c"], k=3)
    counts = {r["y"]: r["count"] for r in out.groupBy("y").count().collect()}
    assert counts == {0: 30, 1: 30}
    synth = out.where(F.col("base_id").isNotNull()).collect()
    assert synth and all(r["c"] in ("red", "white") for r in synth)
    assert all(r["y"] == 1 for r in synth)
