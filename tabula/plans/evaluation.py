"""Metric queries (M1-M5) on labelled documents.

Fixture: ``labels ⋈ documents`` — ``quality`` is the true class, ``toxic``
plays the prediction, ``lang`` is the run key (metrics for all runs in one
job), and ``n_chars`` is the score ranked by the ROC (its negation scores
class 0 in the one-vs-rest view).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabula.operators import metrics as M
from tabula.plans import sqltext as S
from tabula.plans.registry import register
from tabula.sources.readers import read_table


def labelled_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"])
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "lang", "n_chars"])
    return (labels.join(docs, on="doc_id")
            .select("doc_id", F.col("lang").alias("run"), F.col("quality").alias("y_true"),
                    F.col("toxic").alias("y_pred"), F.col("n_chars").cast("double").alias("score1"),
                    (-F.col("n_chars").cast("double")).alias("score0")))


DOCS_SQL = """
    SELECT l.doc_id, d.lang AS run, l.quality AS y_true, l.toxic AS y_pred,
           CAST(d.n_chars AS DOUBLE) AS score1, -CAST(d.n_chars AS DOUBLE) AS score0
    FROM labels l JOIN documents d USING (doc_id)
"""

PER_CLASS_SQL = f"""
    s AS ({DOCS_SQL}),
    cm AS (SELECT run, y_true, y_pred, count(*) AS n FROM s GROUP BY run, y_true, y_pred),
    truth AS (SELECT run, y_true AS cls, sum(n) AS support FROM cm GROUP BY run, y_true),
    preds AS (SELECT run, y_pred AS cls, sum(n) AS n_pred FROM cm GROUP BY run, y_pred),
    tps AS (SELECT run, y_true AS cls, n AS tp FROM cm WHERE y_true = y_pred),
    pc0 AS (SELECT run, cls, CAST(coalesce(tps.tp, 0) AS BIGINT) AS tp,
                   CAST(coalesce(support, 0) AS BIGINT) AS support, CAST(coalesce(n_pred, 0) AS BIGINT) AS n_pred
            FROM truth FULL JOIN preds USING (run, cls) LEFT JOIN tps USING (run, cls)),
    pc AS (SELECT *,
             CASE WHEN n_pred = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / CAST(n_pred AS DOUBLE) END AS precision,
             CASE WHEN support = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / CAST(support AS DOUBLE) END AS recall,
             CASE WHEN support + n_pred = 0 THEN 0.0
                  ELSE CAST(2 * tp AS DOUBLE) / CAST(support + n_pred AS DOUBLE) END AS f1
           FROM pc0)
"""


def _wdiv(num: str, den: str) -> str:
    return f"CASE WHEN {den} = 0 THEN 0.0 ELSE CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) END"


@register("weighted_metrics", f"""
    WITH {PER_CLASS_SQL}
    SELECT run,
      {S.brnd(_wdiv('sum(tp)', 'sum(support)'), 4)} AS val_accuracy,
      {S.brnd(_wdiv('sum(precision * support)', 'sum(support)'), 4)} AS val_precision,
      {S.brnd(_wdiv('sum(recall * support)', 'sum(support)'), 4)} AS val_recall,
      {S.brnd(_wdiv('sum(f1 * support)', 'sum(support)'), 4)} AS val_f1
    FROM pc GROUP BY run
""")
def q_weighted_metrics(spark, sf_dir):
    cm = M.confusion_counts(labelled_docs(spark, sf_dir), "y_true", "y_pred", ["run"])
    return M.weighted_metrics(cm, ["run"], prefix="val_")


@register("classification_report", f"""
    WITH {PER_CLASS_SQL},
    rows AS (
      SELECT run, CAST(cls AS VARCHAR) AS "row", precision, recall, f1, support FROM pc
      UNION ALL
      SELECT run, 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM pc GROUP BY run
      UNION ALL
      SELECT run, 'weighted avg', {_wdiv('sum(precision * support)', 'sum(support)')},
             {_wdiv('sum(recall * support)', 'sum(support)')}, {_wdiv('sum(f1 * support)', 'sum(support)')},
             CAST(sum(support) AS BIGINT) FROM pc GROUP BY run)
    SELECT run, "row", {S.brnd('precision', 4)} AS precision, {S.brnd('recall', 4)} AS recall,
           {S.brnd('f1', 4)} AS f1, support FROM rows
""")
def q_classification_report(spark, sf_dir):
    cm = M.confusion_counts(labelled_docs(spark, sf_dir), "y_true", "y_pred", ["run"])
    return M.classification_report(cm, ["run"])


@register("confusion_matrix", f"""
    WITH s AS ({DOCS_SQL}),
    cm AS (SELECT run, y_true, y_pred, count(*) AS n FROM s GROUP BY run, y_true, y_pred),
    cls AS (SELECT DISTINCT run, c FROM (SELECT run, y_true AS c FROM cm UNION ALL SELECT run, y_pred FROM cm))
    SELECT a.run, a.c AS actual, p.c AS predicted, coalesce(cm.n, 0) AS n
    FROM cls a JOIN cls p USING (run)
    LEFT JOIN cm ON cm.run = a.run AND cm.y_true = a.c AND cm.y_pred = p.c
""")
def q_confusion_matrix(spark, sf_dir):
    cm = M.confusion_counts(labelled_docs(spark, sf_dir), "y_true", "y_pred", ["run"])
    return M.confusion_matrix(cm, ["run"])


_OVR_SQL = f"""
    s AS ({DOCS_SQL}),
    ovr AS (SELECT 0 AS cls, CASE WHEN y_true = 0 THEN 1 ELSE 0 END AS y, score0 AS s FROM s
            UNION ALL
            SELECT 1 AS cls, CASE WHEN y_true = 1 THEN 1 ELSE 0 END AS y, score1 AS s FROM s),
    sc AS (SELECT cls, s AS score, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg
           FROM ovr WHERE s IS NOT NULL GROUP BY cls, s)
"""


def _ovr(spark, sf_dir) -> DataFrame:
    return M.one_vs_rest(labelled_docs(spark, sf_dir), "y_true", {0: "score0", 1: "score1"})


@register("roc_curve", f"""
    WITH {_OVR_SQL},
    c AS (SELECT *,
            sum(pos) OVER w AS cum_pos, sum(neg) OVER w AS cum_neg, row_number() OVER w AS idx,
            lead(pos) OVER w AS np, lead(neg) OVER w AS nn,
            count(*) OVER (PARTITION BY cls) AS m,
            sum(pos) OVER (PARTITION BY cls) AS P, sum(neg) OVER (PARTITION BY cls) AS N
          FROM sc WINDOW w AS (PARTITION BY cls ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT cls, score AS threshold,
           CASE WHEN N = 0 THEN NULL ELSE CAST(cum_neg AS DOUBLE) / CAST(N AS DOUBLE) END AS fpr,
           CASE WHEN P = 0 THEN NULL ELSE CAST(cum_pos AS DOUBLE) / CAST(P AS DOUBLE) END AS tpr
    FROM c WHERE idx = 1 OR np IS NULL OR np <> pos OR nn <> neg OR m <= 2
    UNION ALL
    SELECT cls, CAST('inf' AS DOUBLE), CASE WHEN sum(neg) > 0 THEN 0.0 END, CASE WHEN sum(pos) > 0 THEN 0.0 END
    FROM sc GROUP BY cls
""")
def q_roc_curve(spark, sf_dir):
    return M.roc_points(_ovr(spark, sf_dir), "y", "s", 1, ["cls"])


@register("roc_auc", f"""
    WITH {_OVR_SQL},
    c AS (SELECT *, sum(neg) OVER (PARTITION BY cls ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                    AS cum_neg FROM sc)
    SELECT cls,
           CASE WHEN sum(pos) * sum(neg) > 0
                THEN CAST(sum(pos * ((cum_neg - neg) + neg * 0.5)) AS DOUBLE) / CAST(sum(pos) * sum(neg) AS DOUBLE)
           END AS auc,
           CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg
    FROM c GROUP BY cls
""")
def q_roc_auc(spark, sf_dir):
    return M.roc_auc(_ovr(spark, sf_dir), "y", "s", 1, ["cls"])
