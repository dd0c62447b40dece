"""Properties of the designed operators against brute force on random data, and plan shape."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabula.operators.neighbors import knn
from tabula.operators.quantiles import exact_quantiles
from tabula.operators.ranking import running_totals
from tabula.operators.rebalance import smote, tomek, tomek_links


def _vectors(spark, n=300, d=6, seed=1, dup=0):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, d))
    X[:, 0] *= 5
    if dup:
        X[-dup:] = X[0]
    y = (X[:, 1] > 0.7).astype(int)
    rows = [(i, int(y[i]), [float(v) for v in X[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, y int, vec array<double>"), X, y


def _brute(X, k, exclude_self=True):
    d2 = ((X[:, None, :] - X[None, :, :]) ** 2).sum(-1)
    out = {}
    for i in range(len(X)):
        row = d2[i].copy()
        if exclude_self:
            row[i] = np.inf
        order = np.lexsort((np.arange(len(X)), row))[:k]
        out[i] = [int(j) for j in order]
    return out


@pytest.mark.parametrize("n_pivots,block", [(None, 2048), (12, 16), (1, 100000)])
def test_knn_exact_against_brute_force(spark, n_pivots, block):
    df, X, _ = _vectors(spark, dup=5)
    nn = knn(df, df, 4, "id", "id", "vec", exclude_self=True, n_pivots=n_pivots, block=block).collect()
    got = {}
    for r in nn:
        got.setdefault(r["qid"], []).append((r["rank"], r["nid"]))
    got = {q: [n for _, n in sorted(v)] for q, v in got.items()}
    assert got == _brute(X, 4)


def test_knn_plan_has_no_cartesian_product(spark):
    df, _, _ = _vectors(spark, n=50)
    plan = knn(df, df, 3, "id", "id", "vec")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_exact_quantiles_multi_round_matches_pandas(spark):
    rng = np.random.default_rng(3)
    vals = np.concatenate([rng.normal(size=3000), np.full(500, 1.25), rng.exponential(size=500) * 1e6])
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {r["prob"]: r["value"] for r in exact_quantiles(df, ["x"], probs, n_bins=8, exact_rows=50).collect()}
    s = pd.Series(vals)
    for p in probs:
        assert got[p] == pytest.approx(s.quantile(p), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_running_totals_match_cumsum(spark, coalesce):
    """Per group, also where all scores of one group lie in a narrow band of the other's."""
    rng = np.random.default_rng(5)
    vals = {"wide": rng.permutation(2000).astype(float), "narrow": 1000 + rng.permutation(3000) / 1e6}
    w = {g: rng.integers(0, 5, size=len(v)) for g, v in vals.items()}
    df = spark.createDataFrame([(g, float(v), int(c)) for g in vals for v, c in zip(vals[g], w[g])], "g string, s double, c long")
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, coalesce)
    try:
        out = running_totals(df, "s", ["c"], descending=True, partition_cols=["g"], with_next=["c"]).collect()
    finally:
        spark.conf.set(key, before)
    for g in vals:
        order = np.argsort(-vals[g])
        cum = np.cumsum(w[g][order])
        expected = {vals[g][i]: int(cum[j]) for j, i in enumerate(order)}
        nxt = {vals[g][order[j]]: (int(w[g][order[j + 1]]) if j + 1 < len(order) else None) for j in range(len(order))}
        assert {r["s"]: r["cum_c"] for r in out if r["g"] == g} == expected
        assert {r["s"]: r["next_c"] for r in out if r["g"] == g} == nxt


def test_smote_of_a_tiny_class_spreads_its_slots(spark):
    """Two rows become 200,000: more slots per row than one chunk holds, all of them different."""
    big = spark.range(200_000).select("id", F.lit(0).alias("y"), F.array(F.col("id").cast("double"), F.lit(0.0)).alias("vec"))
    two = spark.createDataFrame([(-1, 1, [0.0, 0.0]), (-2, 1, [1.0, 2.0])], "id long, y int, vec array<double>")
    out = smote(big.union(two), "y", "id", "vec", keep_originals=False)
    r = out.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), F.max("slot").alias("top"),
                F.max(F.abs(F.col("vec")[1] - 2 * F.col("vec")[0])).alias("off")).first()
    assert (r["n"], r["ids"], r["top"]) == (199_998, 199_998, 99_998) and r["off"] < 1e-12


def test_knn_of_vectors_that_are_not_finite(spark):
    rows = [(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [float("nan"), 0.0]), (3, [0.0, float("inf")]), (4, None),
            (5, [3.0, 0.0]), (6, [None, 1.0]), (7, [1e200, 0.0])]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    got = {(r["qid"], r["rank"]): r["nid"] for r in knn(df, df, 2, "id", "id", "vec", exclude_self=True).collect()}
    assert got == {(0, 1): 1, (0, 2): 5, (1, 1): 0, (1, 2): 5, (5, 1): 1, (5, 2): 0}


def test_smote_balances_and_stays_on_segments(spark):
    df, X, y = _vectors(spark, n=200)
    out = smote(df, "y", "id", "vec", k=5).collect()
    counts = pd.Series([r["y"] for r in out]).value_counts()
    assert counts.nunique() == 1
    base = {i: X[i] for i in range(len(X))}
    for r in out:
        if r["base_id"] is None:
            continue
        a, b, v = base[r["base_id"]], base[r["nn_id"]], np.array(r["vec"])
        assert y[r["base_id"]] == y[r["nn_id"]] == r["y"]
        assert np.allclose(v, a + r["gap"] * (b - a)) and 0.0 <= r["gap"] < 1.0


def test_smote_needs_two_rows_per_class(spark):
    df = spark.createDataFrame([(1, 0, [0.0]), (2, 0, [1.0]), (3, 1, [5.0])], "id long, y int, vec array<double>")
    with pytest.raises(ValueError, match="at least 2"):
        smote(df, "y", "id", "vec")


def test_tomek_drops_only_majority_side_of_mutual_pairs(spark):
    df, X, y = _vectors(spark, n=200)
    links = tomek_links(df, "y", "id", "vec").collect()
    nn1 = {q: v[0] for q, v in _brute(X, 1).items()}
    for r in links:
        assert nn1[r["a_id"]] == r["b_id"] and nn1[r["b_id"]] == r["a_id"] and r["a_y"] != r["b_y"]
    kept = {r["id"] for r in tomek(df, "y", "id", "vec").collect()}
    minority = int(pd.Series(y).value_counts().idxmin())
    dropped = set(range(len(X))) - kept
    assert dropped and all(y[i] != minority for i in dropped)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _windows_without_keys(df) -> list:
    """Window nodes of the optimised logical plan whose partition spec is empty."""
    import json
    nodes = json.loads(df._jdf.queryExecution().optimizedPlan().toJSON())
    return [n for n in nodes if n.get("class", "").endswith("logical.Window") and not n.get("partitionSpec")]


def test_operator_plans_have_keyed_windows_and_no_pair_joins(spark):
    from tabula.operators import metrics as M
    from tabula.operators.split import stratified_split

    df, _, _ = _vectors(spark, n=120)
    scored = df.select("id", "y", F.col("vec")[0].alias("s"))
    frames = {
        "split": stratified_split(df, "y", "id"),
        "roc": M.roc_points(scored, "y", "s", 1),
        "auc": M.roc_auc(scored, "y", "s", 1),
        "knn": knn(df, df, 3, "id", "id", "vec", exclude_self=True),
    }
    for name, frame in frames.items():
        plan = _plan(frame)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
        assert _windows_without_keys(frame) == [], name


def test_window_detector_flags_an_unkeyed_window(spark):
    from pyspark.sql import Window
    df = spark.range(10)
    assert _windows_without_keys(df.withColumn("r", F.row_number().over(Window.orderBy("id"))))
    assert not _windows_without_keys(df.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("id"))))
