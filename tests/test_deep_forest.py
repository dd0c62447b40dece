"""Trees without a depth limit: splits against a plain version, pure leaves, draws, both ways of scoring, saving."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabula.operators import deep_forest as D


def frame(spark, x, y):
    rows = [(i, None if v is None else float(v), [float(a) for a in r]) for i, (r, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "row_id long, label double, x array<double>").repartition(4)
    return df.withColumn("features", array_to_vector("x")).withColumn("node", F.lit("extra")).withColumn("c", F.lit("extra"))


def plain(x, y, k):
    def gini(c):
        return c.sum() - (c * c).sum() / c.sum()

    counts = np.bincount(y, minlength=k).astype(float)
    node, best = {"counts": counts.tolist()}, None
    if (counts > 0).sum() > 1:
        for f in range(x.shape[1]):
            for u in np.unique(x[:, f])[:-1]:
                left = np.bincount(y[x[:, f] <= u], minlength=k).astype(float)
                i = (round(gini(left) + gini(counts - left), 9), f, u)
                best = i if best is None or i < best else best
    if best:
        go = x[:, best[1]] <= best[2]
        node |= {"f": best[1], "u": best[2], "left": plain(x[go], y[go], k), "right": plain(x[~go], y[~go], k)}
    return node


def test_one_tree_matches_a_plain_version(spark):
    rng = np.random.default_rng(1)
    x = np.stack([rng.integers(0, 9, 300), rng.integers(0, 7, 300), rng.normal(size=300).round(1), np.ones(300)], 1).astype(float)
    y = rng.integers(0, 3, 300)
    model = D.DeepForest(numTrees=1, drawn=0, bootstrap=False).fit(frame(spark, x, y))
    nodes = {r.node: r for r in model.nodes(spark).collect()}

    def same(i, want):
        r = nodes[i]
        assert r.counts == want["counts"]
        if "f" not in want:
            assert r.feature is None
        else:
            assert (r.feature, r.cut) == (want["f"], want["u"])
            same(r.left, want["left"])
            same(r.right, want["right"])

    same(1, plain(x, y, 3))


def test_deep_and_pure(spark, monkeypatch):
    n = 400
    x = np.stack([np.arange(n), np.zeros(n)], 1).astype(float)
    y = (np.arange(n) // 10) % 2
    df = frame(spark, x, y)
    model = D.DeepForest(numTrees=1, drawn=0, bootstrap=False).fit(df)
    assert model.nodes(spark).agg(F.max("level")).first()[0] > 30
    out = model.transform(df)
    assert out.where("prediction = label").count() == n
    monkeypatch.setattr(D, "NODE_BYTES", 0)  # nodes by joins
    assert sorted((r.row_id, r.prediction, tuple(r.probability)) for r in model.transform(df).collect()) == \
        sorted((r.row_id, r.prediction, tuple(r.probability)) for r in out.collect())


def test_large_nodes_use_bins(spark, monkeypatch):
    monkeypatch.setattr(D, "EXACT_ROWS", 50)
    monkeypatch.setattr(D, "MAX_BINS", 8)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(300, 2)), np.full((80, 2), 0.125)])  # many equal rows: one bin holds them
    y = (np.sin(3 * x[:, 0]) > x[:, 1]).astype(int)
    df = frame(spark, x, y)
    model = D.DeepForest(numTrees=1, drawn=0, bootstrap=False).fit(df)
    assert model.transform(df).where("prediction = label").count() == 380


def test_forest_draws_and_saves(spark, tmp_path):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(300, 6)), rng.integers(0, 2, 300)
    x[:, 0] += 2 * y
    df = frame(spark, x, y)
    model = Pipeline(stages=[D.DeepForest(numTrees=8, seed=1)]).fit(df)
    again = D.DeepForest(numTrees=8, seed=1).fit(df.repartition(2))
    a, b = ({(r.tree, r.level, r.feature, r.cut, tuple(r.counts)) for r in m.nodes(spark).collect()} for m in (model.stages[0], again))
    assert a == b  # draws don't depend on partitions
    roots = {r.tree: r for r in again.nodes(spark).where("node = 1").collect()}
    assert len(roots) == 8 and len({tuple(r.counts) for r in roots.values()}) > 4 and len({r.feature for r in roots.values()}) > 1
    leaves = again.nodes(spark).where("feature is null").collect()
    assert all(sum(c > 0 for c in r.counts) == 1 for r in leaves)  # rows differ, so every leaf is pure
    out = model.transform(df)
    assert out.where("prediction = label").count() > 280
    model.write().overwrite().save(f"{tmp_path}/m")
    back = PipelineModel.load(f"{tmp_path}/m").transform(df)
    assert [r.probability for r in back.orderBy("row_id").collect()] == [r.probability for r in out.orderBy("row_id").collect()]


def test_poisson_weights(spark):
    u = [(i + 0.5) / 10000 for i in range(10000)]
    got = spark.createDataFrame([(v,) for v in u], "u double").select(D.poisson_weight(F.col("u")).alias("w")).groupBy("w").count().collect()
    share = {r.w: r["count"] / 10000 for r in got}
    assert abs(share[0] - 0.3679) < 1e-3 and abs(share[1] - 0.3679) < 1e-3 and abs(share[2] - 0.1839) < 1e-3


def test_odd_inputs(spark):
    x = np.array([[1.0, 2.0]] * 6 + [[float("nan"), 0.0], [3.0, 1.0]])
    y = [0, 0, 1, 1, 1, 0, 1, None]
    df = frame(spark, x, y)
    model = D.DeepForest(numTrees=2, bootstrap=False).fit(df)  # equal rows of both labels: one leaf
    assert model.nodes(spark).count() == 2 and all(r.counts == [3.0, 3.0] for r in model.nodes(spark).collect())
    got = {r.row_id: r.prediction for r in model.transform(df).collect()}
    assert got[0] == 0.0 and got[6] is None and got[7] == 0.0
    one = D.DeepForest(numTrees=3).fit(frame(spark, x[:6], [1] * 6))
    assert {r.prediction for r in one.transform(df.where("row_id < 6")).collect()} == {1.0}
    assert one.transform(df.limit(0)).collect() == []
    with pytest.raises(Exception):
        D.DeepForest(idCol="gone").fit(df)
