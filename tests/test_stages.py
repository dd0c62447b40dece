"""The stage functions end to end on a hand-made table in the original raw layout."""

import os
import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tabula.plans.stages import evaluate_stage, prepare_stage, preprocess_stage, score_stage, train_stage

RAW_COLS = ["fixed acidity", "volatile acidity", "citric acid", "residual sugar", "chlorides",
            "free sulfur dioxide", "total sulfur dioxide", "density", "pH", "sulphates", "alcohol"]


def _raw_csv(n=240, seed=7) -> str:
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, len(RAW_COLS))) + 5
    quality = np.clip(np.round(3 + X[:, 10] - 2 + rng.normal(scale=0.5, size=n) * 2), 3, 9)
    df = pd.DataFrame(X, columns=RAW_COLS)
    df.insert(0, "type", np.where(rng.random(n) < 0.3, "red", "white"))
    df["quality"] = quality
    df.loc[3, "quality"] = np.nan          # unlabelled row: dropped
    df.loc[5, "alcohol"] = np.nan          # missing feature: imputed
    path = os.path.join(tempfile.mkdtemp(prefix="tabula-raw-"), "wine.csv")
    df.to_csv(path, sep=";", index=False)
    return path


def test_stages_end_to_end(spark):
    base = tempfile.mkdtemp(prefix="tabula-stages-")
    processed = preprocess_stage(spark, _raw_csv(), f"{base}/processed")
    assert processed.count() == 239 and set(processed.columns) >= {"ph", "type", "quality"}
    assert {r[0] for r in processed.select("quality").distinct().collect()} <= {0, 1}

    splits = prepare_stage(spark, f"{base}/processed", f"{base}/splits")
    sizes = {r["split"]: r["count"] for r in splits.groupBy("split").count().collect()}
    assert sum(sizes.values()) == 239 and sizes["test"] >= 47

    table, champ = train_stage(spark, f"{base}/splits", f"{base}/models", f"{base}/train_report",
                               algorithms=["logistic_regression", "knn"])
    runs = table.collect()
    assert len(runs) == 4 and all(r["error"] is None for r in runs)
    best = champ.collect()[0]
    assert best["val_f1"] == max(r["val_f1"] for r in runs)

    metrics, errors = evaluate_stage(spark, f"{base}/splits", f"{base}/models", [r["run"] for r in runs],
                                     f"{base}/test_report")
    assert metrics.count() == 4 and errors.count() == 0

    req = spark.read.parquet(f"{base}/processed").drop("quality").limit(10)
    req = req.withColumn("id", F.monotonically_increasing_id()).withColumn("created_at", F.current_timestamp())
    req = req.withColumnRenamed("ph", "pH")
    log = score_stage(spark, req, f"{base}/models/{best['run']}", f"{base}/log")
    again = score_stage(spark, req, f"{base}/models/{best['run']}", f"{base}/log")
    assert log.count() == again.count()
    rows = again.collect()
    assert all(r["quality_label"] in ("Good", "Not Good") for r in rows)
