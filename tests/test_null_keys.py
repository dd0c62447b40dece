"""Metrics, box statistics, SMOTE and pages where keys, labels or vectors are missing."""

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tabula.operators import metrics as M
from tabula.operators.clean import drop_incomplete
from tabula.operators.profile import box_stats, histogram_markers
from tabula.operators.ranking import null_safe_join
from tabula.operators.rebalance import smote, smote_nc
from tabula.sources.readers import read_pages, read_report, with_pages
from tabula.sources.sinks import write_report


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(None, 0, 0, 0.1), (None, 1, 0, 0.6), (None, 1, 1, 0.9), (None, 0, 1, 0.9), ("a", 1, 1, 0.8), ("a", 0, None, 0.3), ("a", None, 1, 0.2), ("a", None, None, None)]
    return spark.createDataFrame(rows + rows[:1], "run string, y int, p int, s double")  # with a repeated row


def test_metrics_of_a_null_run(scored):
    cm = M.confusion_counts(scored, "y", "p", ["run"])
    got = {r.run: r for r in M.weighted_metrics(cm, ["run"]).collect()}
    assert got[None].accuracy == 0.6 and got["a"].accuracy == 0.25
    report = {(r.run, r["row"]): r for r in M.classification_report(cm, ["run"]).collect()}
    assert report[(None, "0")].support == 3 and report[(None, "0")].recall == 0.6667 and report[("a", None)].support == 2
    cells = {(r.run, r.actual, r.predicted): r.n for r in M.confusion_matrix(cm, ["run"]).collect()}
    assert cells[(None, 0, 0)] == 2 and cells[(None, 1, 0)] == 1 and cells[("a", None, None)] == 1 and cells[("a", None, 0)] == 0
    assert len(cells) == 4 + 9


def test_roc_of_a_null_run(scored):
    auc = {r.run: (r.auc, r.n_pos, r.n_neg) for r in M.roc_auc(scored, "y", "s", 1, ["run"]).collect()}
    assert auc == {None: ((1 * 2 + 1 * 2 + 0.5) / 6, 2, 3), "a": (1.0, 1, 1)}
    points = [r for r in M.roc_points(scored, "y", "s", 1, ["run"], drop_intermediate=False).collect() if r.run is None]
    assert sorted((r.fpr, r.tpr) for r in points) == [(0.0, 0.0), (1 / 3, 0.5), (1 / 3, 1.0), (1.0, 1.0)]


def test_box_stats_of_a_null_class(spark):
    df = spark.createDataFrame([(None, float(i)) for i in range(9)] + [("b", 1.0), ("b", float("nan")), ("b", None)], "c string, x double")
    got = {r.c: (r.q1, r.median, r.q3, r.n_fliers) for r in box_stats(df, ["x"], "c").collect()}
    assert got == {None: (2.0, 4.0, 6.0, 0), "b": (1.0, 1.0, 1.0, 0)}
    m = histogram_markers(df.withColumn("z", F.lit(None).cast("double")), ["x", "z"]).collect()
    assert {(r.feature, r.mean, r.median) for r in m} == {("x", 3.7, 3.5), ("z", None, None)}


def test_null_safe_join(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, v int")
    b = spark.createDataFrame([(None, 5), ("x", 6), ("x", 6)], "k string, w int")
    assert sorted(tuple(r) for r in null_safe_join(a, b, ["k"], small=True).collect() if r.k) == [("x", 2, 6)] * 2
    assert {tuple(r) for r in null_safe_join(a, b, ["k"], "left").collect()} == {(None, 1, 5), ("x", 2, 6)}


def test_smote_balance_is_exact(spark):
    bad = [[float("nan"), 1.0], None, [None, 1.0], [float("inf"), 0.0]]
    rows = [(i, 0, [float(i), 1.0]) for i in range(60)] + [(100 + i, 1, bad[i % 4] if i % 3 == 0 else [float(i), 2.0]) for i in range(30)]
    rows += [(200 + i, None, [1.0, 1.0]) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, y int, v array<double>")
    got = {r.y: r["count"] for r in smote(df, "y", "id", "v").groupBy("y").count().collect()}
    assert got == {0: 60, 1: 60, None: 5}
    synthetic = smote(df, "y", "id", "v", keep_originals=False).collect()
    assert all(all(x == x and abs(x) < 1e9 for x in r.v) for r in synthetic)
    mixed = smote_nc(df.withColumn("c", F.when(F.col("id") % 2 == 0, F.lit("a"))), "y", "id", "v", ["c"])
    assert {r.y: r["count"] for r in mixed.groupBy("y").count().collect()} == got
    with pytest.raises(ValueError, match="finite"):
        smote(df.where("y = 0 or id in (100, 101)"), "y", "id", "v").count()


def test_pages_without_keys(spark):
    df = spark.createDataFrame([(k, i) for i, k in enumerate([5, None, 3, 1, None, 4, 2])], "k long, v int")
    pages = [[r.k for r in p.collect()] for p in read_pages(df, "k", 2)]
    assert pages == [[1, 2], [3, 4], [5]]
    assert [[r.k for r in p.collect()] for p in read_pages(df.where("k is null"), "k", 1)] == []
    got = with_pages(df, "k", 2).collect()
    assert sorted((r.page, r.k) for r in got) == [(0, 1), (0, 2), (1, 3), (1, 4), (2, 5)]
    assert with_pages(df.where("k is null"), "k", 2).collect() == []


def test_observed_drops(spark):
    apart = spark.newSession()
    df = apart.createDataFrame([(1, None), (None, None), (2, 3)], "a int, b int")
    seen = Observation("d")
    assert drop_incomplete(df, ["a", "b"], seen).collect() == [(2, 3)]
    assert seen.get == {"rows_in": 3, "rows_dropped": 2, "null_a": 1, "null_b": 2}


def test_report_of_many_runs(spark, tmp_path):
    long = spark.range(3000).selectExpr("concat('run ', id, ' \"x\"') AS run", "'f1' AS metric", "id / 3000 AS value")
    back = read_report(spark, write_report(long, f"{tmp_path}/r.json"))
    assert back.columns == ["run", "metric", "value"] and back.count() == 3000
    assert back.join(long, ["run", "metric", "value"]).count() == 3000


def test_rank_cuts_of_null_groups_and_repeated_keys(spark):
    from tabula.operators.ranking import hashed_segments
    rows = [(i, None if i < 40 else "b") for i in range(100)]
    df = spark.createDataFrame(rows, "id long, g string")
    for buckets in (1, 16, None):
        seg = hashed_segments(df, ["g"], "id", 7, lambda n: [n * 0, F.ceil(n / 4), n + 5], n_buckets=buckets).collect()
        sizes = {(r.g, s): sum(x.g == r.g and x.segment == s for x in seg) for r in seg for s in (0, 1, 2, 3)}
        assert sizes == {(None, 0): 0, (None, 1): 10, (None, 2): 30, (None, 3): 0, ("b", 0): 0, ("b", 1): 15, ("b", 2): 45, ("b", 3): 0}
    twice = hashed_segments(df.union(df), ["g"], "id", 7, lambda n: [F.ceil(n / 4)]).collect()
    assert len(twice) == 200 and len({(r.id, r.segment) for r in twice}) == 100  # rows of one key stay together
    assert hashed_segments(df.limit(0), ["g"], "id", 7, lambda n: [n]).collect() == []
