"""Faults found in review: caps, repeated rows, saved models, swallowed errors, empty results."""

import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tabula.functions.labels import extract_probabilities
from tabula.operators.clean import category_levels, one_hot
from tabula.operators.metrics import metrics_long
from tabula.operators.models import KnnClassifier, load_model, run_grid, save_model
from tabula.operators.preprocess import LevelEncoder
from tabula.operators.quantiles import exact_quantiles
from tabula.operators.rebalance import class_sizes
from tabula.plans.stages import FEATURES, MEASURES, aliased_model, evaluate_stage, numbered_copies, scored_rows, train_stage
from tabula.sources.readers import read_pages, run_history
from tabula.sources.sinks import append_table, write_report
from tabula.streaming.scoring import run_model_stream


def _by_key(df):
    return {(r.g, r.prob): r.value for r in df.collect()}


@pytest.mark.parametrize("extra", [[], [0.0, -0.0, -1e300, 5e-324, 1e-323, 1.5e-323, 2e-323], [float("inf"), float("-inf"), 1.7e308, -1.7e308]])
def test_quantiles_of_values_over_all_scales(spark, extra):
    rng = random.Random(1)
    xs = [10 ** rng.uniform(-300, 300) for _ in range(800)] + extra + [7.0] * 300
    df = spark.createDataFrame([(None if i % 3 else "a", x) for i, x in enumerate(xs)], "g string, x double")
    got = _by_key(exact_quantiles(df, ["x"], [0.0, 0.1, 0.5, 1.0], ["g"], n_bins=64, exact_rows=5))
    for g in ("a", None):
        own = np.sort([x for i, x in enumerate(xs) if (None if i % 3 else "a") == g])
        for p in (0.0, 0.1, 0.5, 1.0):
            pos = (len(own) - 1) * p
            lo, hi = own[int(np.floor(pos))], own[int(np.ceil(pos))]
            assert got[(g, p)] == lo + (hi - lo) * (pos - np.floor(pos)) or lo == hi == got[(g, p)]


def test_quantiles_of_more_groups_than_one_search_holds(spark):
    df = spark.range(600).select((F.col("id") % 60).cast("string").alias("g"), F.col("id").cast("double").alias("x"))
    got = _by_key(exact_quantiles(df, ["x"], [0.5], ["g"], max_keys=20))
    assert got == {(str(g), 0.5): g + 270.0 for g in range(60)}


def test_many_levels_classes_and_metric_names(spark):
    df = spark.range(1200).select(F.concat(F.lit("v"), F.col("id")).alias("c"))
    assert len(category_levels(df, "c")) == 1200 and len(one_hot(df.limit(1), "c", category_levels(df, "c")).columns) == 1200
    assert len(class_sizes(spark.range(10_500), "id")) == 10_500
    m = spark.range(250).select(F.lit("r").alias("run"), F.concat(F.lit("val_"), F.col("id")).alias("metric"), F.lit(1.0).alias("value"))
    assert len(run_history(m).columns) == 251


def test_encoder_keeps_an_empty_level(spark, tmp_path):
    df = spark.createDataFrame([("",), (None,)], "c string")
    model = LevelEncoder(inputCols=["c"]).fit(df)
    model.write().overwrite().save(f"{tmp_path}/enc")
    again = type(model).load(f"{tmp_path}/enc")
    assert again.flag_names() == ["c_"] and sorted(r["c_"] for r in again.transform(df).collect()) == [0.0, 1.0]


def test_copies_get_numbers_of_their_own(spark):
    df = spark.createDataFrame([(1, "a")] * 7 + [(2, None)] * 3 + [(3, "b")], "x int, y string")
    out = numbered_copies(df, "no", chunk=2)
    assert sorted((r.x, r.no) for r in out.collect()) == [(1, i) for i in range(1, 8)] + [(2, 1), (2, 2), (2, 3), (3, 1)]


def test_saved_neighbour_model_holds_its_rows(spark, tmp_path):
    rows = [(str(i), i % 2, Vectors.dense([float(i % 2) * 10 + i / 100, 0.0])) for i in range(40)]
    train = spark.createDataFrame(rows, ["row_key", "label", "features"])
    from pyspark.ml import Pipeline
    model = Pipeline(stages=[KnnClassifier(k=3, idCol="row_key")]).fit(train)
    save_model(model, f"{tmp_path}/knn")
    again = load_model(f"{tmp_path}/knn")
    assert again.stages[0].getOrDefault("path").startswith(str(tmp_path))
    requests = train.drop("row_key", "label")
    out = again.transform(requests)
    assert out.columns[:1] == ["features"] and "row_key" not in out.columns
    assert all(r.prediction == (r.features[0] > 5) for r in out.collect()) and out.count() == 40


def test_grid_of_failing_runs_only(spark):
    df = spark.createDataFrame([(i, i % 2, float(i)) for i in range(30)], "id int, label int, x double")
    runs, scored, models = run_grid(df, df, ["x"], "label", "id", strategies=["Tomek"], algorithms=["no such learner"])
    assert scored.count() == 0 and models == {} and "no such learner" in runs.first().error


def test_last_of_equal_probability_names_wins(spark):
    df = spark.sql("SELECT map('Good', 0.2D, '🟢 Good', 0.7D) AS m")
    neg, pos = extract_probabilities(F.col("m"))
    row = df.select(neg.alias("n"), pos.alias("p")).first()
    assert row.p == 0.7 and abs(row.n - 0.3) < 1e-12


def test_report_can_be_written_again(spark, tmp_path):
    long = metrics_long(spark.createDataFrame([("r", 0.5)], "run string, f1 double"), "run", ["f1"])
    for _ in range(2):
        write_report(long, f"{tmp_path}/report.json")
    assert '"f1": 0.5' in "\n".join(r.value for r in spark.read.text(f"{tmp_path}/report.json").collect())


def test_append_takes_only_a_missing_path_for_a_new_table(spark, tmp_path):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "id int, v string")
    assert append_table(spark, df, f"{tmp_path}/t", key=["id"]) == 2
    assert append_table(spark, df, f"{tmp_path}/t", key=["id"]) == 0
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/t").collect())) == [(1, "a"), (2, "c")]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_bytes(b"not a table at all")
    with pytest.raises(Exception):
        append_table(spark, df, f"{tmp_path}/bad", key=["id"])


def test_all_pages_until_a_short_one(spark):
    df = spark.range(10)
    assert [[r.id for r in p.collect()] for p in read_pages(df, "id", 4)] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]]
    assert [p.count() for p in read_pages(df, "id", 5)] == [5, 5] and list(read_pages(df.limit(0), "id", 5)) == []


def test_models_of_a_folder_champion_and_stream(spark, tmp_path):
    """Folder scan, alias, per-model tables; a model scores new files of a stream as it scores a batch, once each."""
    base = str(tmp_path)
    rng = np.random.default_rng(3)
    rows = [(str(i), int(x[10] > 5), *map(float, x), float(i % 2), float(1 - i % 2), ("train", "train", "val", "test")[i % 4])
            for i, x in enumerate(rng.normal(5, 1, (160, 11)))]
    splits = spark.createDataFrame(rows, ["row_key", "quality", *FEATURES, "split"]).withColumn("quality", F.col("quality").cast("int"))
    splits.write.parquet(f"{base}/splits")
    table, best = train_stage(spark, f"{base}/splits", f"{base}/models", f"{base}/train", algorithms=["logistic_regression", "knn"], strategies=["Tomek"])
    name = best.first().run
    assert aliased_model(spark, f"{base}/models") == f"{base}/models/{name}"
    metrics, errors = evaluate_stage(spark, f"{base}/splits", f"{base}/models", None, f"{base}/test")
    assert {r.run for r in metrics.collect()} == {"Tomek_logistic_regression", "Tomek_knn"} and errors.count() == 0
    for part in ("per_class", "confusion", "roc"):
        assert {r.run for r in spark.read.parquet(f"{base}/test_{part}").select("run").distinct().collect()} == {"Tomek_logistic_regression", "Tomek_knn"}
    requests = splits.where("split = 'test'").select(F.col("row_key").alias("id"), F.lit(None).cast("timestamp_ntz").alias("created_at"), *MEASURES,
                                                     F.when(F.col("type_red") == 1, "red").otherwise("white").alias("type"))
    requests = requests.withColumn("created_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    with pytest.raises(ValueError, match="alcohol"):
        scored_rows(requests.drop("alcohol"), f"{base}/models/{name}")
    for model in ("Tomek_logistic_regression", "Tomek_knn"):
        path, log = f"{base}/models/{model}", f"{base}/log_{model}"
        for part in (0, 1):  # the second file comes later
            requests.where(F.pmod(F.xxhash64("id"), F.lit(2)) == part).coalesce(1).write.mode("append").parquet(f"{base}/in_{model}")
            run_model_stream(spark, f"{base}/in_{model}", requests.schema, path, log, f"{base}/cp_{model}")
        run_model_stream(spark, f"{base}/in_{model}", requests.schema, path, log, f"{base}/cp_{model}_again")  # all files replayed
        want = {r.id: (r.predicted_quality, r.prob_good) for r in scored_rows(requests, path).collect()}
        got = [(r.id, (r.predicted_quality, r.prob_good)) for r in spark.read.parquet(log).collect()]
        assert len(got) == len(want) and dict(got) == want


def test_saved_model_evaluation_covers_the_folder(spark, monkeypatch):
    """Every learner is fitted and saved, and what the folder holds is evaluated."""
    import inspect

    from tabula.operators import models
    from tabula.plans import learners

    seen = {}
    grid = inspect.signature(models.run_grid)

    def fake_grid(*args, **kwargs):
        call = grid.bind(*args, **kwargs)
        call.apply_defaults()
        seen.update(call.arguments)
        return None, None, {}

    def fake_evaluate(paths, test, label, prefix):
        seen["paths"] = paths
        return spark.createDataFrame([("a",)], "run string"), spark.createDataFrame([], "run string, error string")

    monkeypatch.setattr(learners, "run_grid", fake_grid)
    monkeypatch.setattr(learners, "saved_models", lambda spark, folder: {"a": f"{folder}/a"})
    monkeypatch.setattr(learners, "evaluate_saved", fake_evaluate)
    learners.q_saved_model_evaluation(spark, "/root/testdata/sf0.001")
    assert tuple(seen["algorithms"]) == tuple(models.ALGORITHMS) and tuple(seen["strategies"]) == tuple(models.STRATEGIES)
    assert seen["paths"] == {"a": f"{seen['model_dir']}/a"}
