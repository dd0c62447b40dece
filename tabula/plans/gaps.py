"""Queries over tables with NULL runs, classes, labels and vectors that are not finite, and other paths that
complete tables never take (M1-M5, E4, E5, B1, R6, X7, X13, J3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tabula.operators import metrics as M
from tabula.operators import profile as P
from tabula.operators.clean import drop_incomplete, split_target
from tabula.operators.rebalance import smote
from tabula.plans import sqltext as S
from tabula.plans.evaluation import _wdiv, labelled_docs
from tabula.plans.fixtures import ORDERS_LABELLED_SQL, SEED, orders_labelled
from tabula.plans.neighbours import K, embeddings
from tabula.plans.profiling import LI_GAPS_SQL, LONG_SQL, NUM, _sig, lineitem_gaps
from tabula.plans.registry import register
from tabula.session import scratch_path
from tabula.sources.readers import read_table, with_pages

# Rules that make the gaps: German documents have no run, every 11th document no prediction, every 13th no label.
GAPS_SQL = """
    SELECT l.doc_id, CASE WHEN d.lang <> 'de' THEN d.lang END AS run, CASE WHEN l.doc_id % 13 <> 0 THEN l.quality END AS y_true,
           CASE WHEN l.doc_id % 11 <> 0 THEN l.toxic END AS y_pred, CAST(d.n_chars AS DOUBLE) AS score1
    FROM labels l JOIN documents d USING (doc_id)
"""


def gappy_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = labelled_docs(spark, sf_dir)
    return d.select("doc_id", F.when(F.col("run") != "de", F.col("run")).alias("run"),
                    F.when(F.col("doc_id") % 13 != 0, F.col("y_true")).alias("y_true"),
                    F.when(F.col("doc_id") % 11 != 0, F.col("y_pred")).alias("y_pred"), "score1")


_PC = f"""
    s AS ({GAPS_SQL}),
    cls AS (SELECT run, y_true AS cls FROM s UNION SELECT run, y_pred FROM s),
    pc0 AS (SELECT c.run, c.cls,
        count(*) FILTER (WHERE s.y_true IS NOT DISTINCT FROM c.cls) AS support,
        count(*) FILTER (WHERE s.y_pred IS NOT DISTINCT FROM c.cls) AS n_pred,
        count(*) FILTER (WHERE s.y_true = c.cls AND s.y_pred = c.cls) AS tp
        FROM cls c JOIN s ON s.run IS NOT DISTINCT FROM c.run GROUP BY c.run, c.cls),
    pc AS (SELECT *, {_wdiv('tp', 'n_pred')} AS precision, {_wdiv('tp', 'support')} AS recall, {_wdiv('2 * tp', 'support + n_pred')} AS f1 FROM pc0)
"""


@register("metrics_with_gaps", f"""
    WITH {_PC} SELECT run, {S.brnd(_wdiv('sum(tp)', 'sum(support)'), 4)} AS accuracy,
      {S.brnd(_wdiv('sum(precision * support)', 'sum(support)'), 4)} AS precision,
      {S.brnd(_wdiv('sum(recall * support)', 'sum(support)'), 4)} AS recall,
      {S.brnd(_wdiv('sum(f1 * support)', 'sum(support)'), 4)} AS f1 FROM pc GROUP BY run
""")
def q_metrics_with_gaps(spark, sf_dir):
    """M1: a NULL run, NULL labels and NULL predictions."""
    return M.weighted_metrics(M.confusion_counts(gappy_docs(spark, sf_dir), "y_true", "y_pred", ["run"]), ["run"])


@register("report_with_gaps", f"""
    WITH {_PC} SELECT run, CAST(cls AS VARCHAR) AS "row", {S.brnd('precision', 4)} AS precision, {S.brnd('recall', 4)} AS recall,
        {S.brnd('f1', 4)} AS f1, CAST(support AS BIGINT) AS support FROM pc
""")
def q_report_with_gaps(spark, sf_dir):
    """M2: the class rows of the report."""
    rep = M.classification_report(M.confusion_counts(gappy_docs(spark, sf_dir), "y_true", "y_pred", ["run"]), ["run"])
    return rep.where("row IS NULL OR row NOT LIKE '% avg'")


@register("confusion_with_gaps", f"""
    WITH {_PC} SELECT a.run, a.cls AS actual, p.cls AS predicted,
        (SELECT count(*) FROM s WHERE s.run IS NOT DISTINCT FROM a.run AND s.y_true IS NOT DISTINCT FROM a.cls
            AND s.y_pred IS NOT DISTINCT FROM p.cls) AS n
    FROM cls a JOIN cls p ON a.run IS NOT DISTINCT FROM p.run
""")
def q_confusion_with_gaps(spark, sf_dir):
    """M3: every cell of every run, the NULL run and the NULL class included."""
    return M.confusion_matrix(M.confusion_counts(gappy_docs(spark, sf_dir), "y_true", "y_pred", ["run"]), ["run"])


_SC = f"""
    sc AS (SELECT run, score1 AS score, CAST(sum(y_true) AS BIGINT) AS pos, CAST(sum(1 - y_true) AS BIGINT) AS neg
        FROM ({GAPS_SQL}) WHERE y_true IS NOT NULL AND score1 IS NOT NULL GROUP BY run, score1)
"""


@register("roc_with_gaps", f"""
    WITH {_SC}, c AS (SELECT run, score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
        sum(pos) OVER (PARTITION BY run) AS p, sum(neg) OVER (PARTITION BY run) AS n
        FROM sc WINDOW w AS (PARTITION BY run ORDER BY score DESC))
    SELECT run, score AS threshold, CAST(fp AS DOUBLE) / CAST(nullif(n, 0) AS DOUBLE) AS fpr, CAST(tp AS DOUBLE) / CAST(nullif(p, 0) AS DOUBLE) AS tpr FROM c
    UNION ALL SELECT run, CAST('inf' AS DOUBLE), CASE WHEN sum(neg) > 0 THEN 0.0 END, CASE WHEN sum(pos) > 0 THEN 0.0 END FROM sc GROUP BY run
""")
def q_roc_with_gaps(spark, sf_dir):
    """M4: all points of every run."""
    return M.roc_points(gappy_docs(spark, sf_dir), "y_true", "score1", 1, ["run"], drop_intermediate=False)


@register("auc_with_gaps", f"""
    WITH {_SC}, c AS (SELECT *, sum(neg) OVER (PARTITION BY run ORDER BY score) AS cum_neg FROM sc)
    SELECT run, CASE WHEN sum(pos) * sum(neg) > 0
        THEN CAST(sum(pos * ((cum_neg - neg) + neg * 0.5)) AS DOUBLE) / CAST(sum(pos) * sum(neg) AS DOUBLE) END AS auc,
        CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM c GROUP BY run
""")
def q_auc_with_gaps(spark, sf_dir):
    """M5."""
    return M.roc_auc(gappy_docs(spark, sf_dir), "y_true", "score1", 1, ["run"])


@register("box_stats_with_gaps", f"""
    WITH long AS (SELECT nullif(l_returnflag, 'R') AS flag, feature, x FROM {LONG_SQL}),
    q AS (SELECT flag, feature, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3
        FROM long GROUP BY flag, feature),
    f AS (SELECT *, q3 - q1 AS iqr, q1 - {S.dbl(1.5)} * (q3 - q1) AS lo_fence, q3 + {S.dbl(1.5)} * (q3 - q1) AS hi_fence FROM q)
    SELECT f.flag, f.feature, q1, median, q3, iqr, min(CASE WHEN x BETWEEN lo_fence AND hi_fence THEN x END) AS whisker_lo,
        max(CASE WHEN x BETWEEN lo_fence AND hi_fence THEN x END) AS whisker_hi, count(*) FILTER (WHERE x NOT BETWEEN lo_fence AND hi_fence) AS n_fliers
    FROM long JOIN f ON long.flag IS NOT DISTINCT FROM f.flag AND long.feature = f.feature GROUP BY f.flag, f.feature, q1, median, q3, iqr
""")
def q_box_stats_with_gaps(spark, sf_dir):
    """E5: the returned lines have no class."""
    li = lineitem_gaps(spark, sf_dir).withColumn("flag", F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")))
    return P.box_stats(li, NUM, "flag")


@register("histogram_markers", f"""
    SELECT feature, {_sig('avg(x)')} AS mean, quantile_cont(x, 0.5) AS median FROM {LONG_SQL} GROUP BY feature
""")
def q_histogram_markers(spark, sf_dir):
    """Mean and median lines of the histograms."""
    return P.histogram_markers(lineitem_gaps(spark, sf_dir), NUM).withColumn("mean", P.sig(F.col("mean")))


@register("smote_balance_with_gaps", """
    WITH e AS (SELECT CASE WHEN vec_id % 17 <> 0 THEN label END AS label FROM embeddings)
    SELECT label, CASE WHEN label IS NULL THEN count(*) ELSE (SELECT max(n) FROM (SELECT count(*) AS n FROM e WHERE label IS NOT NULL GROUP BY label)) END AS n_rows
    FROM e GROUP BY label
""")
def q_smote_balance_with_gaps(spark, sf_dir):
    """B1: a third of the vectors is not finite and some labels are missing; the classes still come out even."""
    e = embeddings(spark, sf_dir).withColumn("label", F.when(F.col("vec_id") % 17 != 0, F.col("label")))
    gap = F.when(F.col("vec_id") % 6 == 0, F.lit(float("nan"))).when(F.col("vec_id") % 6 == 3, F.lit(None).cast("double"))
    e = e.withColumn("vec", F.when(F.col("vec_id") % 3 == 0, F.transform("vec", lambda x: x + gap)).otherwise(F.col("vec")))
    return smote(e, "label", "vec_id", "vec", k=K, seed=SEED).groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"))


PAGE = 1000


@register("all_pages", f"""
    WITH r AS (SELECT k, (row_number() OVER (ORDER BY k) - 1) // {PAGE} AS page
        FROM (SELECT CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey END AS k FROM orders) WHERE k IS NOT NULL)
    SELECT CAST(page AS BIGINT) AS page, count(*) AS n_rows, min(k) AS first_key, max(k) AS last_key FROM r GROUP BY page
""")
def q_all_pages(spark, sf_dir):
    """All pages of a keyset scan in one job; rows without a key are on none."""
    o = read_table(spark, sf_dir, "orders", ["o_orderkey"]).select(F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey")).alias("k"))
    return with_pages(o, "k", PAGE).groupBy("page").agg(F.count(F.lit(1)).alias("n_rows"), F.min("k").alias("first_key"), F.max("k").alias("last_key"))


@register("observed_drops", f"""
    SELECT count(*) AS rows_in, count(*) FILTER (WHERE {' OR '.join(f'{c} IS NULL' for c in NUM)}) AS rows_dropped,
        {', '.join(f'count(*) FILTER (WHERE {c} IS NULL) AS null_{c}' for c in NUM)},
        count(*) FILTER (WHERE {' AND '.join(f'{c} IS NOT NULL' for c in NUM)}) AS rows_written FROM ({LI_GAPS_SQL})
""")
def q_observed_drops(spark, sf_dir):
    """What the filter dropped, counted by the pass that writes the kept rows."""
    seen, path = Observation("drops"), scratch_path(spark, "complete_rows")
    apart = spark.newSession()  # see drop_incomplete
    drop_incomplete(lineitem_gaps(apart, sf_dir), NUM, seen).write.parquet(path)
    got = seen.get
    one = spark.range(1).select(*[F.lit(v).cast("long").alias(k) for k, v in got.items()])
    written = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows_written"))
    return one.withColumn("rows_written", F.lit(written.first()[0]))


@register("feature_frame", f"SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM ({ORDERS_LABELLED_SQL})")
def q_feature_frame(spark, sf_dir):
    """The features, without the target."""
    x, _ = split_target(orders_labelled(spark, sf_dir).drop("grade"), "label")
    return x


@register("champion_fallback", f"""
    WITH {_PC}, m AS (SELECT coalesce(run, 'none') AS run, {S.brnd(_wdiv('sum(f1 * support)', 'sum(support)'), 4)} AS val_f1 FROM pc GROUP BY run)
    SELECT run, val_f1, 'max' AS source FROM m ORDER BY val_f1 DESC, run LIMIT 1
""")
def q_champion_fallback(spark, sf_dir):
    """The alias names a run that the report does not have, so the greatest score wins."""
    from tabula.plans.training import champion_by_alias
    table = q_metrics_with_gaps(spark, sf_dir).select(F.coalesce("run", F.lit("none")).alias("run"), F.col("f1").alias("val_f1"),
                                                               F.coalesce("run", F.lit("none")).alias("run_order"))
    return champion_by_alias(table, spark.createDataFrame([("wine_gone@champion",)], "registry_name string"))
