"""The stored neighbour index: exact answers, probes, pruned reads, the saved k-NN model."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabula.operators import neighbor_index as N
from tabula.operators.neighbors import knn


def points(spark, n=600, d=4, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, 20, (8, d))
    rows = [(i, [float(v) for v in centre[i % 8] + rng.normal(0, 1, d)]) for i in range(n)]
    rows += [(n + i, rows[7][1]) for i in range(60)]  # equal vectors: ties by id
    rows += [(n + 100, [float("nan")] * d), (n + 101, None), (n + 102, [None] * d), (n + 103, [float("inf")] * d)]
    return spark.createDataFrame(rows, "id long, vec array<double>").withColumn("cell", F.lit("extra")).withColumn("n", F.lit("extra"))


def answers(nn):
    return sorted((r.qid, r["rank"], r.nid, round(r.dist, 9)) for r in nn.collect())


@pytest.mark.parametrize("k,self_", [(1, True), (5, True), (3, False)])
def test_exact_search_equals_knn(spark, tmp_path, k, self_):
    df = points(spark)
    index = N.NeighborIndex(spark, N.build_index(df, str(tmp_path), "id", "vec"))
    assert answers(index.search(df, "id", "vec", k, exclude_self=self_)) == answers(knn(df, df, k, "id", "id", "vec", exclude_self=self_))


def test_only_candidate_cells_are_read(spark, tmp_path):
    df = points(spark)
    path = N.build_index(df, str(tmp_path), "id", "vec")
    index = N.NeighborIndex(spark, path)
    assert len(index.n) >= 8 and index.n.sum() == 660
    one = df.where("id = 0")
    q = one.select(F.col("id").alias("qid"), F.col("vec").alias("v"))
    pairs = index._pairs(q, index._nearest_cells(1, 5))
    plan = index.rows(pairs)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan.replace("PartitionFilters: [isnotnull(cell", "PartitionFilters: [cell")
    assert 0 < index.rows(pairs).count() < 300
    assert answers(index.search(one, "id", "vec", 5)) == answers(knn(one, df, 5, "id", "id", "vec"))


def test_approximate_search(spark, tmp_path):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, [float(v) for v in rng.normal(0, 1, 8)]) for i in range(1500)], "id long, vec array<double>")
    index = N.NeighborIndex(spark, N.build_index(df, str(tmp_path), "id", "vec"))
    probes = N.probes_for(index, 5, 0.95)
    assert 1 <= probes < len(index.n)
    true = {(r.qid, r.nid) for r in knn(df, df, 5, "id", "id", "vec", exclude_self=True).collect()}
    got = index.search(df, "id", "vec", 5, probes=probes, exclude_self=True).collect()
    assert len(got) == 7500 and sorted({r["rank"] for r in got}) == [1, 2, 3, 4, 5]
    assert len(true & {(r.qid, r.nid) for r in got}) / len(true) >= 0.9
    # a probe always finds enough rows: cells are added until k rows are in reach
    assert index.search(df, "id", "vec", 400, probes=1).count() == 1500 * 400


def test_small_and_empty_references(spark, tmp_path):
    df = points(spark)
    few = N.NeighborIndex(spark, N.build_index(df.where("id < 3"), f"{tmp_path}/a", "id", "vec"))
    assert few.search(df.where("id < 10"), "id", "vec", 5).count() == 30
    assert few.search(df.where("id < 10"), "id", "vec", 5, probes=1).count() == 30
    none = N.NeighborIndex(spark, N.build_index(df.where("id < 0"), f"{tmp_path}/b", "id", "vec"))
    assert none.search(df, "id", "vec", 5).collect() == []
    assert few.search(df.where("id < 0"), "id", "vec", 5).collect() == []


def test_very_many_groups_are_searched_without_a_shipped_table(spark, monkeypatch):
    from tabula.operators import neighbors
    df = points(spark).withColumn("g", F.when(F.col("id") % 7 > 0, F.col("id") % 7))
    want = answers(knn(df, df, 3, "id", "id", "vec", group="g", exclude_self=True))
    monkeypatch.setattr(neighbors, "STATS_ROWS", 3)
    got = knn(df.where("g is not null"), df, 3, "id", "id", "vec", group="g", exclude_self=True)
    assert answers(got) == [w for w in want if w[0] % 7]


def test_large_numbers_prune_safely(spark):
    rows = [(i, [1e200 * (i % 5), 1e-3 * i]) for i in range(60)] + [(100 + i, [float(i), 0.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    got = {(r.qid, r["rank"]): r.nid for r in knn(df.where("id >= 100"), df, 2, "id", "id", "vec", exclude_self=True, n_pivots=9).collect()}
    small = [(i, v) for i, v in rows if v[0] < 1e100]
    for i, v in small:
        if i >= 100:
            near = sorted((sum((a - b) ** 2 for a, b in zip(v, w)), j) for j, w in small if j != i)
            assert [got[(i, 1)], got[(i, 2)]] == [j for _, j in near[:2]]
