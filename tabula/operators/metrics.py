"""Classification metrics as aggregate queries.

Everything starts from one shuffle: ``groupBy(run, y_true, y_pred).count()``.
That confusion table has at most ``runs × k²`` rows, so every metric after it
is arithmetic on a tiny table.  Metrics for all runs come out of one job.

Semantics follow the usual definitions with zero division → 0:
precision_c = tp/pred_c, recall_c = tp/support_c, f1_c = 2tp/(support_c + pred_c);
weighted means use support as weight; classes are those seen as label or prediction.
A NULL run is a run of its own; a missing label or prediction is a class of its own
(NULL) and never a hit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabula.operators.ranking import null_safe_join, running_totals
from tabula.session import cut_lineage


def _div0(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def confusion_counts(df: DataFrame, label: str, pred: str, run_cols: Sequence[str] = (),
                     materialize: bool = True) -> DataFrame:
    """``(run..., y_true, y_pred, n)`` — the only pass over the scored rows.

    The result (at most runs × k² rows) is checkpointed by default: every
    metric reads it several times, and the scored rows must be aggregated once.
    """
    cm = (df.groupBy(*run_cols, F.col(label).alias("y_true"), F.col(pred).alias("y_pred"))
          .agg(F.count(F.lit(1)).alias("n")))
    return cut_lineage(cm) if materialize else cm


def per_class(cm: DataFrame, run_cols: Sequence[str] = ()) -> DataFrame:
    """``(run..., cls, tp, support, n_pred, precision, recall, f1)`` from confusion counts."""
    r = list(run_cols)
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("long")
    ends = F.array(F.struct(F.col("y_true").alias("cls"), hit.alias("tp"), F.col("n").alias("support"), zero.alias("n_pred")),
                   F.struct(F.col("y_pred").alias("cls"), zero.alias("tp"), zero.alias("support"), F.col("n").alias("n_pred")))
    out = cm.select(*r, F.explode(ends).alias("e")).groupBy(*r, F.col("e.cls").alias("cls")).agg(
        *[F.sum(f"e.{c}").alias(c) for c in ("tp", "support", "n_pred")])
    return out.select("*", _div0(F.col("tp"), F.col("n_pred")).alias("precision"),
                      _div0(F.col("tp"), F.col("support")).alias("recall"),
                      _div0(2 * F.col("tp"), F.col("support") + F.col("n_pred")).alias("f1"))


def weighted_metrics(cm: DataFrame, run_cols: Sequence[str] = (), prefix: str = "",
                     decimals: int | None = 4) -> DataFrame:
    """Accuracy and support-weighted precision / recall / F1 per run (M1), rounded half-even."""
    r = list(run_cols)
    pc = per_class(cm, r)
    agg = pc.groupBy(*r).agg(
        F.sum("support").alias("_n"), F.sum("tp").alias("_tp"),
        F.sum(F.col("precision") * F.col("support")).alias("_p"),
        F.sum(F.col("recall") * F.col("support")).alias("_r"),
        F.sum(F.col("f1") * F.col("support")).alias("_f"))

    def fin(c: Column) -> Column:
        return F.bround(c, decimals) if decimals is not None else c

    return agg.select(*r, fin(_div0(F.col("_tp"), F.col("_n"))).alias(f"{prefix}accuracy"),
                      fin(_div0(F.col("_p"), F.col("_n"))).alias(f"{prefix}precision"),
                      fin(_div0(F.col("_r"), F.col("_n"))).alias(f"{prefix}recall"),
                      fin(_div0(F.col("_f"), F.col("_n"))).alias(f"{prefix}f1"))


def classification_report(cm: DataFrame, run_cols: Sequence[str] = ()) -> DataFrame:
    """Per class rows plus ``macro avg`` and ``weighted avg`` rows (M2).

    Output ``(run..., row, precision, recall, f1, support)`` with ``row`` the
    class as text or the name of the mean.
    """
    r = list(run_cols)
    pc = per_class(cm, r)
    classes = pc.select(*r, F.col("cls").cast("string").alias("row"), "precision", "recall", "f1", "support")
    macro = pc.groupBy(*r).agg(F.lit("macro avg").alias("row"), F.avg("precision").alias("precision"),
                               F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
                               F.sum("support").alias("support"))
    weighted = pc.groupBy(*r).agg(
        F.lit("weighted avg").alias("row"),
        _div0(F.sum(F.col("precision") * F.col("support")), F.sum("support")).alias("precision"),
        _div0(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("recall"),
        _div0(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("f1"),
        F.sum("support").alias("support"))
    out = classes.unionByName(macro).unionByName(weighted)
    return out.select(*r, "row", *[F.bround(c, 4).alias(c) for c in ("precision", "recall", "f1")], "support")


def confusion_matrix(cm: DataFrame, run_cols: Sequence[str] = ()) -> DataFrame:
    """Every (actual, predicted) cell over the run's classes, zeros included (M3), long form."""
    r = list(run_cols)
    if not r:
        return confusion_matrix(cm.withColumn("_all", F.lit(0)), ["_all"]).drop("_all")
    classes = (cm.select(*r, F.col("y_true").alias("c")).unionByName(cm.select(*r, F.col("y_pred").alias("c")))
               .distinct())
    grid = null_safe_join(classes.withColumnRenamed("c", "actual"), classes.withColumnRenamed("c", "predicted"), r)
    cells = cm.select(*r, F.col("y_true").alias("actual"), F.col("y_pred").alias("predicted"), "n")
    return null_safe_join(grid, cells, [*r, "actual", "predicted"], "left").select(
        *r, "actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


# ── M4 / M5 ─────────────────────────────────────────────────────────────────
def score_counts(df: DataFrame, label: str, score: str, positive, group_cols: Sequence[str] = ()) -> DataFrame:
    """``(group..., score, pos, neg)`` — positives and negatives per distinct score (ties merged);
    rows without a score or a label take no part."""
    is_pos = (F.col(label) == F.lit(positive)).cast("long")
    return (df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
            .groupBy(*group_cols, F.col(score).cast("double").alias("score"))
            .agg(F.sum(is_pos).alias("pos"), F.sum(1 - is_pos).alias("neg")))


def roc_points(df: DataFrame, label: str, score: str, positive, group_cols: Sequence[str] = (),
               drop_intermediate: bool = True) -> DataFrame:
    """ROC curve ``(group..., threshold, fpr, tpr)`` for ``label == positive`` ranked by ``score``.

    One point per distinct score (descending) plus the ``(+inf, 0, 0)`` start.
    With ``drop_intermediate`` a point is dropped when it is collinear with its
    neighbours, i.e. the count step into it equals the step out of it.
    Running totals and the next point are taken in two levels (score ranges,
    then inside a range), never in one global window.
    """
    g = list(group_cols)
    if not g:
        return roc_points(df.withColumn("_all", F.lit(0)), label, score, positive, ["_all"],
                          drop_intermediate).drop("_all")
    # Distinct-score counts: read twice below, aggregated from the scored rows once.
    sc = cut_lineage(score_counts(df, label, score, positive, g).withColumn("one", F.lit(1)))
    cum = running_totals(sc, "score", ["pos", "neg", "one"], descending=True, partition_cols=g,
                         with_next=["pos", "neg"])
    totals = sc.groupBy(*g).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"), F.count(F.lit(1)).alias("m"))
    cum = null_safe_join(cum, totals, g, small=True)
    first = F.col("cum_one") == 1
    last = F.col("next_pos").isNull()
    bend = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
    keep = first | last | bend | (F.col("m") <= 2) if drop_intermediate else F.lit(True)
    pts = cum.where(keep).select(*g, F.col("score").alias("threshold"),
                                 F.try_divide(F.col("cum_neg").cast("double"), F.col("N").cast("double")).alias("fpr"),
                                 F.try_divide(F.col("cum_pos").cast("double"), F.col("P").cast("double")).alias("tpr"))
    start = totals.select(*g, F.lit(float("inf")).alias("threshold"),
                          F.when(F.col("N") > 0, F.lit(0.0)).alias("fpr"),
                          F.when(F.col("P") > 0, F.lit(0.0)).alias("tpr"))
    return start.unionByName(pts)


def roc_auc(df: DataFrame, label: str, score: str, positive, group_cols: Sequence[str] = ()) -> DataFrame:
    """Tie-aware AUC ``(group..., auc, n_pos, n_neg)``; NULL when a class is absent (M5).

    AUC = Σ_s pos(s)·(neg below s + ½·neg(s)) / (P·N).  The numerator is a sum
    of halves of integers, exact in double, so the result does not depend on
    summation order.  The "neg below" count is a running total in two levels.
    """
    g = list(group_cols)
    if not g:
        return roc_auc(df.withColumn("_all", F.lit(0)), label, score, positive, ["_all"]).drop("_all")
    sc = score_counts(df, label, score, positive, g)
    cum = running_totals(sc, "score", ["neg"], descending=False, partition_cols=g)
    # cum_neg includes this score's negatives; those strictly below are cum_neg - neg.
    part = cum.select(*g, (F.col("pos") * ((F.col("cum_neg") - F.col("neg")) + F.col("neg") * F.lit(0.5))).alias("u"),
                      "pos", "neg")
    agg = part.groupBy(*g).agg(F.sum("u").alias("u"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    den = (F.col("n_pos") * F.col("n_neg")).cast("double")
    return agg.select(*g, F.when(den > 0, F.col("u") / den).alias("auc"), "n_pos", "n_neg")


def one_vs_rest(df: DataFrame, label: str, score_cols: dict, group_cols: Sequence[str] = ()) -> DataFrame:
    """Long frame ``(group..., cls, y, s)``: for each class its indicator and its score column."""
    parts = F.array(*[F.struct(F.lit(c).alias("cls"), F.col(s).cast("double").alias("s")) for c, s in score_cols.items()])
    return (df.select(*group_cols, F.col(label).alias("_y"), F.explode(parts).alias("_p"))
            .select(*group_cols, "_p.cls", (F.col("_y") == F.col("_p.cls")).cast("int").alias("y"), "_p.s"))


# ── M7 / M8 / M9 ────────────────────────────────────────────────────────────
def metrics_long(wide: DataFrame, run: str, metric_cols: Sequence[str]) -> DataFrame:
    """``(run, metric, value)`` from a wide per-run table."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metric_cols])
    return wide.select(run, F.explode(rows).alias("r")).select(run, "r.metric", "r.value")


def summary_table(long: DataFrame, run: str, metrics: Sequence[str]) -> DataFrame:
    """Run × metric pivot (M7); metric names are given, so no discovery pass."""
    return long.groupBy(run).pivot("metric", list(metrics)).agg(F.first("value"))


def champion(runs: DataFrame, score: str = "val_f1", order: str = "run_order") -> DataFrame:
    """The run with the greatest score; ties go to the earliest run (M8). Top-1, no sort of all rows."""
    return runs.orderBy(F.col(score).desc_nulls_last(), F.col(order).asc()).limit(1)


def best_per_group(runs: DataFrame, group: str, score: str, order: str = "run_order",
                   cols: Sequence[str] = ("run",)) -> DataFrame:
    """Per group the max score and its run, earliest run on ties (M9) — ``max_by`` on a struct."""
    key = F.struct(F.col(score), (-F.col(order)).alias("_o"))
    return runs.groupBy(group).agg(F.max(score).alias(f"best_{score}"),
                                   *[F.max_by(F.col(c), key).alias(c) for c in cols])
