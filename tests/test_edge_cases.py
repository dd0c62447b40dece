"""Hand-made frames for the edge cases of FIXTURES.md §B and the reference defects of SURVEY §0."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabula.functions.labels import class_label, confidence, extract_probabilities, split_run_name, strip_registry_name
from tabula.functions.scalars import binarize, clean_label, nan_to_null, safe_double
from tabula.operators import metrics as M
from tabula.operators.clean import align_features, normalize_columns, one_hot, unify_schema
from tabula.operators.preprocess import MedianImputer, PopulationScaler
from tabula.operators.split import stratified_split


def test_binarize_rounds_half_even_before_threshold(spark):
    df = spark.createDataFrame([(6.0,), (7.0,), (6.5,), (6.7,), (7.5,), (None,)], "q double")
    got = [r[0] for r in df.select(binarize("q", 7)).collect()]
    assert got == [0, 1, 0, 1, 1, None]


def test_non_finite_become_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (float("-inf"),), (None,)], "x double")
    assert [r[0] for r in df.select(nan_to_null("x")).collect()] == [1.0, None, None, None, None]


def test_median_imputer_skips_missing_and_fills(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (None,), (float("nan"),)], "x double")
    df = df.select(nan_to_null("x").alias("x"))
    model = MedianImputer(inputCols=["x"]).fit(df)
    assert model.getOrDefault(model.medians) == [2.0]
    assert [r[0] for r in model.transform(df).collect()] == [1.0, 2.0, 4.0, 2.0, 2.0]


def test_scaler_uses_population_std_and_constant_divides_by_one(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, c double")
    model = PopulationScaler(inputCols=["a", "c"]).fit(df)
    out = model.transform(df).collect()
    assert [r["a"] for r in out] == [-1.0, 1.0]          # population std of (1, 3) is 1
    assert [r["c"] for r in out] == [0.0, 0.0]


def test_name_collision_is_an_error(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "` pH ` double, ph double")
    with pytest.raises(ValueError, match="collision"):
        normalize_columns(df)


def test_unify_schema_fills_missing_optional(spark):
    df = spark.createDataFrame([(1, 2.0)], "`Customer Key` int, acctbal double")
    out = unify_schema(df, {"key": ["key", "customer key"], "bal": ["acctbal"]}, optional={"type": "string"})
    assert out.columns == ["key", "bal", "type"]
    assert out.collect()[0]["type"] is None


def test_one_hot_null_and_unseen_are_all_zero(spark):
    df = spark.createDataFrame([("red",), ("white",), (None,), ("rose",)], "type string")
    out = one_hot(df, "type", levels=["red", "white"]).collect()
    assert [(r["type_red"], r["type_white"]) for r in out] == [(1.0, 0.0), (0.0, 1.0), (0.0, 0.0), (0.0, 0.0)]


def test_align_strict_and_lenient(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, extra double")
    assert align_features(df, ["b", "a"]).columns == ["b", "a"]
    with pytest.raises(ValueError):
        align_features(df, ["b", "a"], strict=True)


@pytest.mark.parametrize("sizes", [[1, 2, 5], [7, 40, 3]])
def test_split_sizes_exact_disjoint_and_partition_independent(spark, sizes):
    rows = [(i, c) for c, n in enumerate(sizes) for i in range(c * 1000, c * 1000 + n)]
    df = spark.createDataFrame(rows, "id long, y int")
    a = {r["id"]: r["split"] for r in stratified_split(df.repartition(2), "y", "id").collect()}
    b = {r["id"]: r["split"] for r in stratified_split(df.repartition(64), "y", "id", n_buckets=16).collect()}
    assert a == b and len(a) == len(rows)
    for c, n in enumerate(sizes):
        got = [a[i] for i in range(c * 1000, c * 1000 + n)]
        n_test = math.ceil(0.2 * n)
        n_val = math.ceil(0.25 * (n - n_test))
        assert got.count("test") == n_test and got.count("val") == n_val
        assert got.count("train") == n - n_test - n_val


def _cm(spark, pairs, runs=None):
    df = spark.createDataFrame(pairs, "y int, p int")
    return M.confusion_counts(df, "y", "p")


def test_zero_division_is_zero_and_class_never_predicted(spark):
    cm = _cm(spark, [(0, 0), (0, 0), (1, 0)])
    m = M.weighted_metrics(cm).collect()[0]
    assert m["accuracy"] == round(2 / 3, 4)
    # class 1 never predicted: its precision is 0, not an error
    pc = {r["cls"]: r for r in M.per_class(cm).collect()}
    assert pc[1]["precision"] == 0.0 and pc[1]["f1"] == 0.0


def test_confusion_matrix_has_zero_cells(spark):
    cm = _cm(spark, [(0, 0), (1, 1), (1, 1)])
    cells = {(r["actual"], r["predicted"]): r["n"] for r in M.confusion_matrix(cm).collect()}
    assert cells == {(0, 0): 1, (0, 1): 0, (1, 0): 0, (1, 1): 2}


@pytest.mark.parametrize("scores,expected", [([0.5, 0.5, 0.5, 0.5], 0.5), ([0.1, 0.2, 0.8, 0.9], 1.0),
                                             ([0.9, 0.8, 0.2, 0.1], 0.0)])
def test_auc_tied_perfect_reversed(spark, scores, expected):
    df = spark.createDataFrame(list(zip([0, 0, 1, 1], scores)), "y int, s double")
    assert M.roc_auc(df, "y", "s", 1).collect()[0]["auc"] == expected


def test_auc_null_when_one_class_absent(spark):
    df = spark.createDataFrame([(1, 0.3), (1, 0.5)], "y int, s double")
    assert M.roc_auc(df, "y", "s", 1).collect()[0]["auc"] is None


def test_roc_positive_class_orientation(spark):
    """Defect 2 of the reference: ROC for class 0 must use class 0's own score."""
    df = spark.createDataFrame([(0, 0.9, 0.1), (0, 0.8, 0.2), (1, 0.3, 0.7), (1, 0.1, 0.9)], "y int, s0 double, s1 double")
    ovr = M.one_vs_rest(df, "y", {0: "s0", 1: "s1"})
    aucs = {r["cls"]: r["auc"] for r in M.roc_auc(ovr, "y", "s", 1, ["cls"]).collect()}
    assert aucs == {0: 1.0, 1: 1.0}


def test_roc_drops_collinear_points(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (1, 0.7), (0, 0.1)], "y int, s double")
    pts = sorted((r["fpr"], r["tpr"]) for r in M.roc_points(df, "y", "s", 1).collect())
    assert pts == [(0.0, 0.0), (0.0, 1 / 3), (0.0, 1.0), (1.0, 1.0)]


def test_champion_tie_goes_to_earliest(spark):
    runs = spark.createDataFrame([(1, "a", 0.9), (2, "b", 0.9), (3, "c", 0.8)], "run_order int, run string, val_f1 double")
    assert M.champion(runs).collect()[0]["run"] == "a"


@pytest.mark.parametrize("m,expected", [({"🟢 Good": 0.8}, (0.2, 0.8)), ({"Bom": 0.3}, (0.7, 0.3)),
                                        ({"x": 1.0}, (0.0, 0.0)), ({"Not Good": 0.25, "Good": 0.75}, (0.25, 0.75))])
def test_probability_extraction(spark, m, expected):
    df = spark.createDataFrame([(m,)], "m map<string,double>")
    neg, pos = extract_probabilities(F.col("m"))
    r = df.select(neg.alias("n"), pos.alias("p")).collect()[0]
    assert (round(r["n"], 10), round(r["p"], 10)) == expected


def test_labels_and_names(spark):
    df = spark.createDataFrame([(0, "SMOTE_random_forest"), (5, "single")], "c int, run string")
    s, a = split_run_name(F.col("run"))
    r = df.select(clean_label(class_label("c")).alias("l"), s.alias("s"), a.alias("a"),
                  strip_registry_name(F.lit("wine_Tomek_knn@champion")).alias("n"),
                  safe_double(F.lit("x1")).alias("d"),
                  confidence(F.array(F.lit(0.3), F.lit(0.7)), F.lit(1)).alias("conf")).collect()
    assert (r[0]["l"], r[0]["s"], r[0]["a"], r[0]["n"], r[0]["d"], r[0]["conf"]) == \
        ("Not Good", "SMOTE", "random_forest", "Tomek_knn", 0.0, 0.7)
    assert (r[1]["l"], r[1]["s"], r[1]["a"]) == ("5", "single", "Unknown")


def test_split_keeps_rows_with_null_class(spark):
    rows = [(i, None if i % 3 == 0 else i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, y int")
    out = stratified_split(df, "y", "id", n_buckets=16).collect()
    assert len(out) == 60
    nulls = [r["split"] for r in out if r["y"] is None]
    assert nulls.count("test") == math.ceil(0.2 * 20)


def test_original_layouts_unify_and_score_inputs_validate(spark):
    from tabula.functions.schema import INPUT_BOUNDS, INPUT_DEFAULTS, SCORING_FEATURE_ORDER, processed_projection
    from tabula.operators.clean import range_violation_counts
    raw = spark.createDataFrame([tuple([7.0] * 11) + (6.7,), tuple([7.0] * 11) + (None,)],
                                ", ".join(f"`{c}` double" for c in [
                                    "fixed acidity", "volatile acidity", "citric acid", "residual sugar", "chlorides",
                                    "free sulfur dioxide", "total sulfur dioxide", "density", "pH", "sulphates",
                                    "alcohol", "quality"]))
    aliases, optional, label = processed_projection()
    out = unify_schema(raw, aliases, optional).where(F.col("quality").isNotNull()).withColumn("quality", label("quality"))
    r = out.collect()
    assert len(r) == 1 and r[0]["quality"] == 1 and r[0]["type"] is None
    enc = one_hot(out, "type", levels=["red", "white"])
    assert align_features(enc, SCORING_FEATURE_ORDER).columns == SCORING_FEATURE_ORDER
    defaults = spark.createDataFrame([tuple(INPUT_DEFAULTS[c] for c in INPUT_BOUNDS)],
                                     ", ".join(f"{c} double" for c in INPUT_BOUNDS))
    v = range_violation_counts(defaults, INPUT_BOUNDS).collect()
    assert all(x["n_below"] == 0 and x["n_above"] == 0 for x in v)
