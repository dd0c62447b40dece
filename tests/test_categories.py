"""Categories as tables: sparse encoding, mixed distances and SMOTE-NC with very many levels."""

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tabula.operators.neighbors import knn
from tabula.operators.preprocess import SparseLevelEncoder, make_preprocessor
from tabula.operators.rebalance import smote_nc


def test_sparse_encoder(spark, tmp_path):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", None), (None, 2)], "c string, n int").withColumn("place", F.lit("extra"))
    model = SparseLevelEncoder(inputCols=["c", "n"], outputCols=["cv", "nv"]).fit(df)
    new = spark.createDataFrame([("a", 1, "x"), ("zz", 2, "x"), (None, 99, "x"), ("b", None, "x")], "c string, n int, place string")
    got = [(r.c, *map(list, (r.cv.toArray(), r.nv.toArray()))) for r in model.transform(new).collect()]
    assert sorted(got, key=repr) == sorted([("a", [1, 0], [1, 0]), ("zz", [0, 0], [0, 1]), (None, [0, 0], [0, 0]), ("b", [0, 1], [0, 0])], key=repr)
    assert model.transform(new).columns == ["c", "n", "place", "cv", "nv"]
    empty = SparseLevelEncoder(inputCols=["c"], outputCols=["cv"]).fit(df.limit(0))
    assert [list(r.cv.toArray()) for r in empty.transform(new).collect()] == [[0]] * 4


def test_a_hundred_thousand_levels(spark, tmp_path):
    n = 100_000
    df = spark.range(n).selectExpr("id", "cast(id as double) as x", "concat('level ', id) as c", "cast(id < 300 as int) as y")
    model = make_preprocessor(["x"], ["c"]).fit(df)
    out = model.transform(df.where("id in (0, 7, 99999)"))
    rows = {r.id: r.features for r in out.collect()}
    assert all(v.size == n + 1 and v.numNonzeros() == 2 for v in rows.values())
    levels = sorted(f"level {i}" for i in range(n))
    assert all(v[1 + levels.index(f"level {i}")] == 1.0 for i, v in rows.items())
    model.write().overwrite().save(f"{tmp_path}/m")
    again = PipelineModel.load(f"{tmp_path}/m").transform(df.where("id = 7")).first().features
    assert again == rows[7]
    made = smote_nc(df.withColumn("v", F.array("x", F.lit(1.0))), "y", "id", "v", ["c"])
    assert {r.y: r["count"] for r in made.groupBy("y").count().collect()} == {0: n - 300, 1: n - 300}
    assert made.where("c is null").count() == 0


def test_mixed_distances(spark):
    rng = np.random.default_rng(2)
    rows = [(i, i % 2, [float(v) for v in rng.normal(0, 2, 3)], int(rng.integers(0, 4)), int(rng.integers(0, 3))) for i in range(300)]
    weight = {0: 1.5, 1: 4.0}
    df = spark.createDataFrame([(i, g, [*v, float(a), float(b), weight[g]]) for i, g, v, a, b in rows], "id long, g int, vec array<double>")
    for block in (16384, 50):
        got = {(r.qid, r["rank"]): (r.nid, r.dist) for r in knn(df, df, 3, "id", "id", group="g", exclude_self=True, n_cat=2, block=block).collect()}
        for i, g, v, a, b in rows:
            d = sorted((np.sqrt(sum((p - q) ** 2 for p, q in zip(v, w)) + weight[g] * ((a != c) + (b != e))), j) for j, h, w, c, e in rows if h == g and j != i)
            for r in range(3):
                assert got[(i, r + 1)][0] == d[r][1] and abs(got[(i, r + 1)][1] - d[r][0]) < 1e-9


def test_votes_and_missing_categories(spark):
    rows = [(i, 0, [float(i), 0.0], "red", None) for i in range(30)] + [(100 + i, 1, [float(i), 1.0], "a" if i % 2 else None, None) for i in range(10)]
    out = smote_nc(spark.createDataFrame(rows, "id long, y int, num array<double>, c string, e string"), "y", "id", "num", ["c", "e"], k=3)
    assert out.count() == 60 and out.where("e is not null").count() == 0
    assert {r.c for r in out.where("base_id is not null").collect()} <= {"a", None}
