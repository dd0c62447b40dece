"""Run grids and run reports.

Two grids:

* the **k-NN grid** on embeddings — strategies SMOTE and Tomek × k-NN with
  k ∈ {1, 3, 5}, scored on the validation and test splits.  Every step is
  exact and deterministic, so the grid and every report built on it have a
  DuckDB oracle;
* the **learner grid** on orders (features joined from lineitem) — the six
  Spark ML / k-NN learners × two strategies; learners differ from any SQL
  engine, so those queries are checked by rows only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabula.functions.labels import best_f1, split_run_name, strip_registry_name
from tabula.operators import metrics as M
from tabula.operators.neighbors import knn, knn_vote
from tabula.operators.rebalance import smote, tomek
from tabula.operators.split import stratified_split
from tabula.plans import sqltext as S
from tabula.plans.fixtures import split_sql
from tabula.plans.neighbours import EMB_SQL, K, SEED, _d2, embeddings, smote_ctes, tomek_ctes
from tabula.plans.registry import register
from tabula.session import cut_lineage, scratch_path
from tabula.sources.readers import read_report, run_history
from tabula.sources.sinks import write_report

KS = [1, 3, 5]
METRICS = ["accuracy", "precision", "recall", "f1"]


# ── Spark side ──────────────────────────────────────────────────────────────
def knn_grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``(runs, scored)``: run table and predictions of every run on val and test."""
    s = cut_lineage(stratified_split(embeddings(spark, sf_dir), "label", "vec_id", seed=SEED))
    tr = s.where(F.col("split") == "train")
    ev = s.where(F.col("split") != "train")
    sm = smote(tr, "label", "vec_id", "vec", k=K, seed=SEED).select(F.col("id").alias("rid"), "label", "vec")
    tk = tomek(tr, "label", "vec_id", "vec", seed=SEED).select(F.col("vec_id").alias("rid"), "label", "vec")
    truth = ev.select("vec_id", "split", F.col("label").alias("y_true"))
    runs, preds, order = [], [], 0
    for strat, ref in (("SMOTE", sm), ("Tomek", tk)):
        ref = cut_lineage(ref)
        n_ref = ref.count()
        nn = cut_lineage(knn(ev, ref, max(KS), "vec_id", "rid", "vec"))
        for kk in KS:
            order += 1
            run = f"{strat}_knn{kk}"
            vote = knn_vote(nn.where(F.col("rank") <= kk), ref, "rid", "label")
            preds.append(truth.join(vote.withColumnRenamed("qid", "vec_id"), on="vec_id")
                         .select(F.lit(run).alias("run"), "vec_id", "split", "y_true", "y_pred"))
            runs.append((order, run, strat, f"knn{kk}", n_ref))
    sizes = {r["split"]: r["n"] for r in ev.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    run_df = spark.createDataFrame(runs, "run_order int, run string, strategy string, model string, train_samples bigint")
    run_df = (run_df.withColumn("val_samples", F.lit(sizes.get("val", 0)).cast("bigint"))
              .withColumn("test_samples", F.lit(sizes.get("test", 0)).cast("bigint")))
    return run_df, cut_lineage(reduce(DataFrame.unionByName, preds))


def split_metrics(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Validation and test metrics of all runs from one confusion aggregate."""
    wm = M.weighted_metrics(M.confusion_counts(scored, "y_true", "y_pred", ["run", "split"]), ["run", "split"])
    val = wm.where(F.col("split") == "val").select("run", *[F.col(m).alias(f"val_{m}") for m in METRICS])
    test = wm.where(F.col("split") == "test").select("run", *[F.col(m).alias(f"test_{m}") for m in METRICS])
    return val, test


def _grid(spark, sf_dir):
    """The grid's run table and metrics, from the tables under ``sf_dir`` as they are now."""
    runs, scored = knn_grid(spark, sf_dir)
    val, test = split_metrics(scored)
    return cut_lineage(runs), cut_lineage(val), cut_lineage(test)


# ── DuckDB side ─────────────────────────────────────────────────────────────
def _metrics_ctes(src: str, keys: list[str], p: str) -> str:
    k = ", ".join(keys)
    return f"""
    {p}cm AS (SELECT {k}, y_true, y_pred, count(*) AS n FROM {src} GROUP BY {k}, y_true, y_pred),
    {p}truth AS (SELECT {k}, y_true AS cls, sum(n) AS support FROM {p}cm GROUP BY {k}, y_true),
    {p}preds AS (SELECT {k}, y_pred AS cls, sum(n) AS n_pred FROM {p}cm GROUP BY {k}, y_pred),
    {p}tps AS (SELECT {k}, y_true AS cls, n AS tp FROM {p}cm WHERE y_true = y_pred),
    {p}pc0 AS (SELECT {k}, cls, CAST(coalesce(tps.tp, 0) AS BIGINT) AS tp,
                   CAST(coalesce(support, 0) AS BIGINT) AS support, CAST(coalesce(n_pred, 0) AS BIGINT) AS n_pred
               FROM {p}truth FULL JOIN {p}preds USING ({k}, cls) LEFT JOIN {p}tps tps USING ({k}, cls)),
    {p}pc AS (SELECT *,
             CASE WHEN n_pred = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / CAST(n_pred AS DOUBLE) END AS precision,
             CASE WHEN support = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / CAST(support AS DOUBLE) END AS recall,
             CASE WHEN support + n_pred = 0 THEN 0.0
                  ELSE CAST(2 * tp AS DOUBLE) / CAST(support + n_pred AS DOUBLE) END AS f1
           FROM {p}pc0),
    {p}m AS (SELECT {k},
      {S.brnd(_wdiv('sum(tp)', 'sum(support)'), 4)} AS accuracy,
      {S.brnd(_wdiv('sum(precision * support)', 'sum(support)'), 4)} AS precision,
      {S.brnd(_wdiv('sum(recall * support)', 'sum(support)'), 4)} AS recall,
      {S.brnd(_wdiv('sum(f1 * support)', 'sum(support)'), 4)} AS f1
      FROM {p}pc GROUP BY {k})
"""


def _wdiv(num: str, den: str) -> str:
    return f"CASE WHEN {den} = 0 THEN 0.0 ELSE CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) END"


GRID_SQL = f"""
WITH s AS ({split_sql(EMB_SQL, 'label', 'vec_id', SEED)}),
tr AS (SELECT vec_id, label, v FROM s WHERE split = 'train'),
ev AS (SELECT vec_id, label, v, split FROM s WHERE split <> 'train'),
{smote_ctes('tr', 'sm_')},
smref AS (SELECT CAST(vec_id AS VARCHAR) AS rid, label, v FROM tr UNION ALL SELECT id, label, nv FROM sm_syn),
{tomek_ctes('tr', 'tk_')},
tkref AS (SELECT vec_id AS rid, label, v FROM tk_kept),
smr AS (SELECT q.vec_id AS qid, r.label AS nl,
               row_number() OVER (PARTITION BY q.vec_id ORDER BY {_d2('q', 'r')}, r.rid) AS rk FROM ev q, smref r),
tkr AS (SELECT q.vec_id AS qid, r.label AS nl,
               row_number() OVER (PARTITION BY q.vec_id ORDER BY {_d2('q', 'r')}, r.rid) AS rk FROM ev q, tkref r),
nn AS (SELECT 'SMOTE' AS strategy, qid, nl, rk FROM smr WHERE rk <= {max(KS)}
       UNION ALL SELECT 'Tomek', qid, nl, rk FROM tkr WHERE rk <= {max(KS)}),
ks AS (SELECT unnest({KS}) AS k),
votes AS (SELECT strategy, k, qid, nl, count(*) AS c FROM nn, ks WHERE rk <= k GROUP BY strategy, k, qid, nl),
best AS (SELECT strategy, k, qid, nl AS y_pred,
                row_number() OVER (PARTITION BY strategy, k, qid ORDER BY c DESC, nl) AS o FROM votes),
scored AS (SELECT b.strategy || '_knn' || CAST(b.k AS VARCHAR) AS run, ev.vec_id, ev.split, ev.label AS y_true, b.y_pred
           FROM best b JOIN ev ON ev.vec_id = b.qid WHERE b.o = 1),
{_metrics_ctes('scored', ['run', 'split'], 'g_')},
mval AS (SELECT run, {', '.join(f'{m} AS val_{m}' for m in METRICS)} FROM g_m WHERE split = 'val'),
mtest AS (SELECT run, {', '.join(f'{m} AS test_{m}' for m in METRICS)} FROM g_m WHERE split = 'test'),
refsize AS (SELECT 'SMOTE' AS strategy, count(*) AS n FROM smref UNION ALL SELECT 'Tomek', count(*) FROM tkref),
runs AS (SELECT CAST(row_number() OVER (ORDER BY CASE strategy WHEN 'SMOTE' THEN 0 ELSE 1 END, k) AS INTEGER) AS run_order,
                strategy || '_knn' || CAST(k AS VARCHAR) AS run, strategy, 'knn' || CAST(k AS VARCHAR) AS model,
                CAST(n AS BIGINT) AS train_samples,
                (SELECT count(*) FROM ev WHERE split = 'val') AS val_samples,
                (SELECT count(*) FROM ev WHERE split = 'test') AS test_samples
         FROM refsize, ks)
"""


# ── Queries ─────────────────────────────────────────────────────────────────
@register("grid_runs", GRID_SQL + """
    SELECT runs.*, mval.val_accuracy, mval.val_precision, mval.val_recall, mval.val_f1
    FROM runs LEFT JOIN mval USING (run)
""")
def q_grid_runs(spark, sf_dir):
    runs, val, _ = _grid(spark, sf_dir)
    return runs.join(val, on="run", how="left")


@register("grid_test_metrics", GRID_SQL + "SELECT * FROM mtest")
def q_grid_test_metrics(spark, sf_dir):
    return _grid(spark, sf_dir)[2]


@register("report_val_test", GRID_SQL + f"""
    SELECT run, val_f1, test_f1, {S.brnd('val_f1 - test_f1', 4)} AS overfit_gap
    FROM mval LEFT JOIN mtest USING (run)
""")
def q_report_val_test(spark, sf_dir):
    _, val, test = _grid(spark, sf_dir)
    j = val.join(test, on="run", how="left")
    return j.select("run", "val_f1", "test_f1", F.bround(F.col("val_f1") - F.col("test_f1"), 4).alias("overfit_gap"))


@register("champion", GRID_SQL + """
    SELECT run, run_order, val_f1 FROM runs JOIN mval USING (run)
    ORDER BY val_f1 DESC NULLS LAST, run_order LIMIT 1
""")
def q_champion(spark, sf_dir):
    runs, val, _ = _grid(spark, sf_dir)
    return M.champion(runs.join(val, on="run"), "val_f1", "run_order").select("run", "run_order", "val_f1")


@register("best_by_strategy", GRID_SQL + """
    SELECT strategy, max(test_f1) AS best_test_f1,
           arg_max(run, (test_f1, -run_order)) AS run
    FROM runs JOIN mtest USING (run) GROUP BY strategy
""")
def q_best_by_strategy(spark, sf_dir):
    runs, _, test = _grid(spark, sf_dir)
    return M.best_per_group(runs.join(test, on="run"), "strategy", "test_f1", "run_order", ["run"])


@register("strategy_side_by_side", GRID_SQL + """
    SELECT model, max(CASE WHEN strategy = 'SMOTE' THEN val_f1 END) AS "SMOTE",
                  max(CASE WHEN strategy = 'Tomek' THEN val_f1 END) AS "Tomek"
    FROM runs JOIN mval USING (run) GROUP BY model
""")
def q_strategy_side_by_side(spark, sf_dir):
    runs, val, _ = _grid(spark, sf_dir)
    return runs.join(val, on="run").groupBy("model").pivot("strategy", ["SMOTE", "Tomek"]).agg(F.max("val_f1"))


SUMMARY = ["val_accuracy", "val_f1", "test_accuracy", "test_f1"]


@register("summary_table", GRID_SQL + f"""
    SELECT run, {', '.join(SUMMARY)} FROM mval JOIN mtest USING (run)
""")
def q_summary_table(spark, sf_dir):
    _, val, test = _grid(spark, sf_dir)
    long = M.metrics_long(val, "run", [f"val_{m}" for m in METRICS]).unionByName(
        M.metrics_long(test, "run", [f"test_{m}" for m in METRICS]))
    return M.summary_table(long, "run", SUMMARY)


@register("run_name_parts", GRID_SQL + """
    SELECT run, split_part(run, '_', 1) AS strategy,
           CASE WHEN strpos(run, '_') > 0 THEN substr(run, strpos(run, '_') + 1) ELSE 'Unknown' END AS algorithm,
           'wine_' || run || '@champion' AS registry_name, run AS stripped
    FROM runs
""")
def q_run_name_parts(spark, sf_dir):
    runs, _, _ = _grid(spark, sf_dir)
    strat, algo = split_run_name(F.col("run"))
    reg = F.concat(F.lit("wine_"), F.col("run"), F.lit("@champion"))
    return runs.select("run", strat.alias("strategy"), algo.alias("algorithm"), reg.alias("registry_name"),
                       strip_registry_name(reg).alias("stripped"))


@register("best_f1_aliases", GRID_SQL + """
    SELECT run, greatest(coalesce(val_f1, 0.0), 0.0, 0.0) AS best_f1 FROM mval
""")
def q_best_f1_aliases(spark, sf_dir):
    _, val, _ = _grid(spark, sf_dir)
    m = F.map_from_arrays(F.array(*[F.lit(f"val_{x}") for x in METRICS]),
                          F.array(*[F.col(f"val_{x}") for x in METRICS]))
    return val.select("run", best_f1(m).alias("best_f1"))


@register("report_roundtrip", GRID_SQL + f"""
    SELECT run, metric, value FROM (UNPIVOT mval ON {', '.join(f'val_{m}' for m in METRICS)} INTO NAME metric VALUE value)
""")
def q_report_roundtrip(spark, sf_dir):
    _, val, _ = _grid(spark, sf_dir)
    path = scratch_path(spark, "training_report")
    write_report(M.metrics_long(val, "run", [f"val_{m}" for m in METRICS]), path)
    return read_report(spark, path)


@register("run_history", GRID_SQL + "SELECT * FROM mval")
def q_run_history(spark, sf_dir):
    _, val, test = _grid(spark, sf_dir)
    long = M.metrics_long(val, "run", [f"val_{m}" for m in METRICS]).unionByName(
        M.metrics_long(test, "run", [f"test_{m}" for m in METRICS]))
    return run_history(long, "val_")


@register("champion_lookup", GRID_SQL + """
    , ranked AS (SELECT run, val_f1, row_number() OVER (ORDER BY val_f1 DESC NULLS LAST, run_order) AS o
                 FROM runs JOIN mval USING (run)),
    alias AS (SELECT 'wine_' || run || '@champion' AS registry_name FROM ranked WHERE o = 1)
    SELECT r.run, m.val_f1, 'alias' AS source
    FROM alias a JOIN runs r ON r.run = replace(replace(a.registry_name, '@champion', ''), 'wine_', '')
    JOIN mval m USING (run)
""")
def q_champion_lookup(spark, sf_dir):
    runs, val, _ = _grid(spark, sf_dir)
    table = runs.join(val, on="run")
    alias = M.champion(table, "val_f1", "run_order").select(
        F.concat(F.lit("wine_"), F.col("run"), F.lit("@champion")).alias("registry_name"))
    return champion_by_alias(table, alias)


def champion_by_alias(table: DataFrame, alias: DataFrame) -> DataFrame:
    """The run named by the alias table if it is in the report, else the best by ``val_f1``."""
    named = alias.select(strip_registry_name(F.col("registry_name")).alias("run"))
    hit = table.join(named, on="run", how="left_semi").select("run", "val_f1", F.lit("alias").alias("source"))
    n_hit = hit.agg(F.count(F.lit(1))).scalar()
    fallback = (M.champion(table, "val_f1", "run_order")
                .select("run", "val_f1", F.lit("max").alias("source")).where(n_hit == 0))
    return hit.unionByName(fallback)


# Fixed parameters: alert thresholds on validation metrics.
ALERTS = {"val_f1": 0.9, "val_accuracy": 0.9}


@register("metric_alerts", GRID_SQL + " UNION ALL ".join(
    f" SELECT run, '{m}' AS metric, {m} AS value, {S.dbl(t)} AS threshold FROM mval WHERE {m} < {S.dbl(t)}"
    for m, t in ALERTS.items()))
def q_metric_alerts(spark, sf_dir):
    from tabula.operators.drift import metric_alerts
    _, val, _ = _grid(spark, sf_dir)
    return metric_alerts(val, ALERTS)
