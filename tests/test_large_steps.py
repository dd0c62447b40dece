"""Steps whose cost must not grow with the number of cells, cuts or levels."""

import numpy as np
from pyspark.sql import functions as F

from tabula.operators import deep_forest, models, neighbors


def test_forest_bins_are_found_once_per_row(spark):
    cuts = [[1.0, 2.0, 4.0], []]
    df = spark.createDataFrame([(0, [0.5, 7.0]), (1, [1.0, 7.0]), (2, [3.0, 7.0]), (3, [4.0, 7.0])], "id int, x array<double>")
    got = {r.id: list(r.b) for r in df.withColumn("b", deep_forest._bin_names(cuts)("x")).collect()}
    inf = float("inf")
    assert got == {0: [1.0, inf], 1: [2.0, inf], 2: [4.0, inf], 3: [inf, inf]}
    state = df.select(F.lit(0).alias("tree"), F.lit(1).cast("long").alias("node"), F.lit(2 ** 62).cast("long").alias("size"), F.lit(0).alias("tried"),
                      F.col("id").alias("c"), F.lit(1.0).alias("w"), "x", F.array(F.lit(1.0), F.lit(inf)).alias("b"))
    plan = deep_forest.DeepForest()._splits(state, cuts, 2, 2, 2, 1)._jdf.queryExecution().analyzed().toString()
    assert "filter(" not in plan  # no level walks through the cuts of every row


def test_a_query_goes_once_to_neighbouring_cells(spark, monkeypatch):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, [float(v) for v in rng.normal(0, 1, 8)]) for i in range(600)], "id long, vec array<double>")
    sent = []
    real = neighbors.search_cells
    monkeypatch.setattr(neighbors, "search_cells", lambda L, Lx, *a, **k: sent.append(Lx.count()) or real(L, Lx, *a, **k))
    nn = neighbors.knn(df, df, 3, "id", "id", "vec", exclude_self=True, n_pivots=25)
    assert nn.count() == 1800 and sent == [600]  # 25 cells that nothing prunes fit one block: a copy of each query, not 25


def test_block_search_against_brute_force():
    rng = np.random.default_rng(4)
    for dims, n_cat, scale in ((2, 0, 1.0), (2, 2, 1.0), (20, 0, 1.0), (3, 0, 1e160)):
        q, x = rng.integers(0, 9, (700, dims)) * scale / 8, rng.integers(0, 9, (1500, dims)) * scale / 8
        if n_cat:
            code = lambda n: np.hstack([rng.integers(0, 3, (n, n_cat)), np.full((n, 1), 0.25)])
            q, x = np.hstack([q, code(len(q))]), np.hstack([x, code(len(x))])
        ids = rng.permutation(1500)
        got = neighbors._block_topk(np.arange(700), q, ids, x, 4, True, n_cat)
        by = {a: list(zip(g["nid"], g["d2"])) for a, g in got.groupby("qid")}
        nq, nx = neighbors._numbers(q, n_cat), neighbors._numbers(x, n_cat)
        for i in range(0, 700, 7):
            with np.errstate(over="ignore"):
                d2 = ((nq[i] - nx) ** 2).sum(1)
            if n_cat:
                d2 = d2 + 0.25 * sum(q[i, c] != x[:, c] for c in range(dims, dims + n_cat))
            want = sorted((d, j) for d, j in zip(d2, ids) if j != i and np.isfinite(d))[:4]
            assert [(d, j) for j, d in by.get(i, [])] == want


def test_regions_hold_a_block_of_rows():
    points = np.array([[0.0], [10.0], [1.0], [11.0], [2.0]])
    region = neighbors.merged_cells(points, np.arange(5), np.array([5, 5, 5, 5, 50]), 10)
    assert len(set(region)) >= 3 and all(sum(np.array([5, 5, 5, 5, 50])[region == r]) <= 10 for r in set(region) if (region == r).sum() > 1)


def test_grid_reads_a_strategy_table_once(spark, monkeypatch):
    rows = [(i, int(i % 3 == 0), float(i % 7), float(i % 5)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, label int, a double, b double")
    seen = []
    real = type(df).first
    monkeypatch.setattr(type(df), "first", lambda self: seen.append(self.columns) or real(self))
    runs, scored, fitted = models.run_grid(df.where("id < 45"), df.where("id >= 45"), ["a", "b"], "label", "id", strategies=["SMOTE"],
                                           algorithms=["logistic_regression", "logistic_regression"], parallel=1)
    assert [r.error for r in runs.collect()] == [None, None] and scored.count() == 30
    assert seen.count(["id", "label", "features"]) == 1


def test_single_precision_screens_and_equal_rows_keep_the_answer(monkeypatch):
    rng = np.random.default_rng(6)
    for q, x in ((rng.normal(0, 1, (300, 40)), rng.normal(0, 1, (900, 40))), (1e6 + rng.normal(0, 1e-3, (300, 40)), 1e6 + rng.normal(0, 1e-3, (900, 40))),
                 (rng.integers(0, 3, (300, 2)) * 1.0, rng.integers(0, 3, (900, 2)) * 1.0)):
        ids = rng.permutation(900)
        got = neighbors._block_topk(np.arange(300), q, ids, x, 5, True, 0)
        by = {a: list(zip(g["d2"], g["nid"])) for a, g in got.groupby("qid")}
        for i in range(300):
            d2 = ((q[i] - x) ** 2).sum(1)
            assert by[i] == sorted((d, j) for d, j in zip(d2, ids) if j != i)[:5]
    # 9 different rows on each side: no block searches 300 queries
    seen, real = [], neighbors._nearest_rows
    monkeypatch.setattr(neighbors, "_nearest_rows", lambda a, b, *r: seen.append((len(a), len(b))) or real(a, b, *r))
    neighbors._block_topk(np.arange(300), q, ids, x, 5, True, 0)
    assert seen == [(9, 54)]


def test_vectors_are_packed_without_loss():
    m = np.array([[0.5, -3.0, 1e20], [0.1, 2.0, -0.0], [1e300, 0.0, 1.0]])
    rows = np.array(neighbors.packed(m), dtype=object)
    assert [len(r) for r in rows] == [24, 24, 24] or [len(r) for r in rows] == [12, 24, 24]
    assert neighbors.unpacked(rows, 3).tobytes() == m.tobytes()
    assert [len(r) for r in neighbors.packed(np.float64(np.float32(m[:1] / 3)))] == [12]


def test_large_tables_have_few_copies():
    sizes = [neighbors.block_rows(n, 64, 12) for n in (1_000, 100_000, 1_000_000)]
    assert sizes == [2048, 16_667, 131_072]


def test_categories_bound_the_leaves_that_are_searched(monkeypatch):
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.uniform(0, 7, 6000), rng.integers(1, 367, 6000), rng.integers(0, 3, 6000), rng.integers(0, 5, 6000), np.full(6000, 1400.0)])
    cost, real = [], neighbors._mismatches
    monkeypatch.setattr(neighbors, "_mismatches", lambda a, b, n: cost.append(len(a) * len(b)) or real(a, b, n))
    got = neighbors._block_topk(np.arange(6000), x, np.arange(6000), x, 6, True, 2).sort_values(["qid", "d2", "nid"])
    assert sum(cost) < 0.08 * 6000 * 6000  # 0.067 of all pairs; 0.100 with leaves of all categories
    for i in range(0, 6000, 500):
        d2 = ((x[i, :2] - x[:, :2]) ** 2).sum(1) + 1400.0 * ((x[i, 2:4] != x[:, 2:4]).sum(1))
        near = sorted((d, j) for j, d in enumerate(d2) if j != i)[:6]
        assert got[got["qid"] == i]["nid"].tolist() == [j for _, j in near]


def test_rows_of_a_repeated_id_share_their_neighbours(spark):
    df = spark.createDataFrame([(i, [float(i), 0.0]) for i in (0, 0, 1, 3, 7)] + [(None, [2.0, 0.0])], "id long, vec array<double>")
    got = [(r.qid, r["rank"], r.nid) for r in neighbors.knn(df.where("id = 0 or id is null"), df.where("id > 0"), 5, "id", "id", "vec").collect()]
    assert sorted(got) == [(0, 1, 1), (0, 2, 1), (0, 3, 1), (0, 4, 1), (0, 5, 3)]


def test_a_bound_spares_most_of_a_block():
    rng = np.random.default_rng(11)
    x = np.hstack([rng.normal(0, 1, (3000, 4)), rng.integers(0, 4, (3000, 3))])
    x[::7] = x[1]  # equal rows
    ids = np.arange(3000)
    key = lambda f: f.sort_values(["qid", "d2", "nid"]).to_numpy().tolist()
    for exclude in (True, False):
        want = neighbors._block_topk(ids, x, ids, x, 3 + exclude, exclude, 0)
        kth = np.full(len(x), np.inf)
        far = want.groupby("qid")["d2"].apply(lambda d: d.iloc[2])
        kth[far.index] = far.to_numpy() * (1 + 1e-9)
        kth[5:2000:50] = np.inf  # no bound known
        got = neighbors._block_topk(ids, x, ids, x, 3 + exclude, exclude, 0, kth)
        within = lambda f: f[f["d2"] <= kth[f["qid"]]]
        top = lambda f: within(f).sort_values(["qid", "d2", "nid"]).groupby("qid").head(3)
        assert key(top(got)) == key(top(want))


def test_screened_pairs_fall_with_a_bound(monkeypatch):
    rng = np.random.default_rng(12)
    x, ids = rng.random((6000, 3)), np.arange(6000)
    seen, real = [], neighbors._marked
    monkeypatch.setattr(neighbors, "_marked", lambda m: seen.append(m.size) or real(m))
    neighbors._block_topk(ids, x, ids, x, 2, True, 0)
    whole, _ = sum(seen), seen.clear()
    neighbors._block_topk(ids, x, ids, x, 2, True, 0, np.full(6000, 0.06 ** 2))
    assert sum(seen) * 2 < whole


def test_few_dimensions_are_searched_with_a_bound(spark, monkeypatch):
    rng = np.random.default_rng(13)
    points = np.round(rng.normal(0, 1, (900, 3)), 1)  # ties and equal rows
    bounded, real = [], neighbors.search_cells
    monkeypatch.setattr(neighbors, "search_cells", lambda L, Lx, *a, **k: bounded.append("b" in Lx.columns) or real(L, Lx, *a, **k))
    rows = [(i, int(i % 3 == 0), [float(v) for v in p]) for i, p in enumerate(points)] + [(None, 0, [0.0] * 3), (901, None, [0.0] * 3), (902, 0, [float("nan")] * 3)]
    df = spark.createDataFrame(rows, "id long, y int, vec array<double>")
    got = neighbors.knn(df.where("id < 900"), df.where("id < 900"), 4, "id", "id", "vec", group="y", exclude_self=True, n_pivots=20, block=100).collect()
    assert bounded == [False, True]  # the nearest cell first, then only what its k-th distance leaves
    d2 = ((points[:, None] - points[None]) ** 2).sum(2)
    d2[np.eye(900, dtype=bool)] = np.inf
    d2[(np.arange(900)[:, None] % 3 == 0) != (np.arange(900)[None] % 3 == 0)] = np.inf
    want = {(i, r + 1): int(j) for i in range(900) for r, j in enumerate(np.lexsort((np.arange(900), d2[i]))[:4])}
    assert {(r.qid, r["rank"]): r.nid for r in got} == want
    odd = neighbors.knn(df, df, 2, "id", "id", "vec", group="y", n_pivots=20, block=100)
    assert {r.qid for r in odd.select("qid").distinct().collect()} == set(range(900))  # no id, no group, not finite: not searched
    bounded.clear()
    twice = neighbors.knn(df.unionByName(df.limit(5)), df.where("id < 900"), 2, "id", "id", "vec", n_pivots=20, block=100)
    assert bounded == [False] and twice.count() == 1800 + 2  # a repeated id: as before, in one round


def test_saved_models_are_scored_side_by_side(spark, monkeypatch):
    import threading
    both = threading.Barrier(2, timeout=30)

    def load(path):
        both.wait()  # one by one, the first would wait in vain
        raise ValueError(path)

    monkeypatch.setattr(models, "load_model", load)
    out, errors = models.score_saved({"B_svm": "b", "A_mlp": "a", "C_knn": "c", "D_knn": "d"}, spark.range(1), "id")
    assert out is None and [tuple(r) for r in errors.collect()] == [(r, f"ValueError: {r[0].lower()}") for r in ("A_mlp", "B_svm", "C_knn", "D_knn")]
    assert models.longest_first(["B_svm", "C_knn", "A_knn"]) == ["A_knn", "C_knn", "B_svm"]
