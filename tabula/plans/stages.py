"""The reference's stages as library calls over the original table layout.

Each stage reads what the previous one wrote (paths in the shared folder or
any Hadoop file system) and is a composition of the library's operators:

* ``preprocess_stage`` — CSV (separator probe) → either raw layout unified →
  typed projection → labelled rows only → binary label → Parquet (plan A);
* ``prepare_stage`` — one-hot ``type`` (fixed levels) → keyed stratified
  split → Parquet partitioned by ``split``;
* ``train_stage`` — SMOTE / Tomek × learners on train, validation metrics for
  all runs, models saved, run table and JSON report written, champion row (plan B);
* ``evaluate_stage`` — every saved model on the test split, failures isolated;
* ``score_stage`` — a saved model over a batch of requests → prediction-log
  rows appended idempotently (plan C on a batch; the stream form is
  :mod:`tabula.streaming.scoring`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabula.functions.labels import class_label, extract_probabilities
from tabula.functions.scalars import clean_label
from tabula.functions.schema import INPUT_BOUNDS, TYPE_LEVELS, processed_projection
from tabula.operators.clean import align_features, clean_non_finite, normalize_columns, one_hot, unify_schema
from tabula.operators.metrics import champion, classification_report, confusion_counts, confusion_matrix, metrics_long, roc_points
from tabula.operators.models import grid_metrics, load_model, run_grid, saved_models, score_saved, scored
from tabula.operators.split import stratified_split
from tabula.session import cut_lineage
from tabula.sources.readers import read_csv_auto
from tabula.sources.sinks import append_table, write_parquet, write_report

MEASURES = list(INPUT_BOUNDS)
FEATURES = MEASURES + [f"type_{v}" for v in TYPE_LEVELS]


def preprocess_stage(spark: SparkSession, raw_csv: str, out_path: str) -> DataFrame:
    """Raw CSV (either layout) → processed Parquet: 11 doubles, ``type``, binary ``quality``."""
    raw = read_csv_auto(spark, raw_csv)
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    aliases, optional, label = processed_projection()
    typed = unify_schema(raw, aliases, optional)
    typed = typed.select(*[F.col(c).cast("double").alias(c) for c in MEASURES], F.col("type").cast("string"),
                         F.col("quality"))
    typed = clean_non_finite(typed, MEASURES)
    out = typed.where(F.col("quality").isNotNull()).withColumn("quality", label("quality"))
    write_parquet(out, out_path)
    return spark.read.parquet(out_path)


def numbered_copies(df: DataFrame, out: str, chunk: int = 4096) -> DataFrame:
    """``df`` with equal rows numbered from 1.  Copies are counted (so a row that fills a third of the
    table is one row per task) and spread out again in bounded chunks; no window over equal rows."""
    n = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    n = n.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(chunk).cast("long"))))
    return n.withColumn(out, F.explode(F.sequence(F.col("_from") + 1, F.least(F.col("_from") + chunk, F.col("_n"))))).drop("_n", "_from")


def prepare_stage(spark: SparkSession, processed: str, out_path: str, key: str = "row_key",
                  seed: int = 42) -> DataFrame:
    """One-hot ``type`` and the 60/20/20 split, written partitioned by ``split``.

    The row key is a hash of the row's content (the source has no id) and, as equal rows
    need keys of their own, the number of the copy.  So split membership is reproducible
    from the data alone, whatever order it is read in.
    """
    df = numbered_copies(spark.read.parquet(processed), "_copy")
    content = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])
    df = df.withColumn(key, F.sha2(content, 256)).drop("_copy")
    df = one_hot(df, "type", levels=TYPE_LEVELS)
    out = stratified_split(df, "quality", key, seed=seed)
    write_parquet(out, out_path, partition_by=["split"])
    return spark.read.parquet(out_path)


def train_stage(spark: SparkSession, splits: str, model_dir: str, report_path: str, key: str = "row_key",
                seed: int = 42, algorithms=None, strategies=None) -> tuple[DataFrame, DataFrame]:
    """Fit the grid on train, score validation; returns ``(runs_with_metrics, champion_row)``."""
    s = spark.read.parquet(splits)
    kwargs = {}
    if algorithms is not None:
        kwargs["algorithms"] = algorithms
    if strategies is not None:
        kwargs["strategies"] = strategies
    runs, scored_val, _ = run_grid(s.where(F.col("split") == "train"), s.where(F.col("split") == "val"),
                                   FEATURES, "quality", key, seed=seed, model_dir=model_dir, **kwargs)
    metrics = cut_lineage(grid_metrics(scored_val, "val_"))
    write_report(metrics_long(metrics, "run", ["val_accuracy", "val_precision", "val_recall", "val_f1"]),
                 report_path)
    table = runs.join(metrics, on="run", how="left")
    best = cut_lineage(champion(table.where(F.col("error").isNull()), "val_f1", "run_order"))
    best.select(F.lit("champion").alias("alias"), "run").write.mode("overwrite").parquet(_alias_path(model_dir))
    return table, best


def _alias_path(model_dir: str) -> str:
    return f"{model_dir.rstrip('/')}/_aliases"


def aliased_model(spark: SparkSession, model_dir: str, alias: str = "champion") -> str:
    """Path of the model that ``alias`` names in the folder's alias table."""
    row = spark.read.parquet(_alias_path(model_dir)).where(F.col("alias") == alias).first()
    if row is None:
        raise ValueError(f"no model has the alias {alias!r}")
    return f"{model_dir.rstrip('/')}/{row['run']}"


def evaluate_stage(spark: SparkSession, splits: str, model_dir: str, runs: list[str] | None, report_path: str):
    """Test metrics of the named runs, or of every model in the folder; returns ``(metrics, errors)``.

    Beside the report, writes a table each of the per-class reports, the confusion
    matrices and the ROC points (of the runs that give probabilities) of all models."""
    test = spark.read.parquet(splits).where(F.col("split") == "test")
    paths = saved_models(spark, model_dir) if runs is None else {r: f"{model_dir.rstrip('/')}/{r}" for r in runs}
    rows, errors = score_saved(paths, test, "quality")
    if rows is None:
        return None, errors
    rows = cut_lineage(rows)
    metrics = grid_metrics(rows, "test_")
    write_report(metrics_long(metrics, "run", ["test_accuracy", "test_precision", "test_recall", "test_f1"]),
                 report_path)
    counts = confusion_counts(rows, "y_true", "y_pred", ["run"])
    tables = {"per_class": classification_report(counts, ["run"]), "confusion": confusion_matrix(counts, ["run"]),
              "roc": roc_points(rows.where(F.col("p1").isNotNull()), "y_true", "p1", 1, ["run"])}
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{report_path.rstrip('/')}_{name}")
    return metrics, errors


def score_stage(spark: SparkSession, requests: DataFrame, model_path: str, log_path: str, id_col: str = "id",
                ts_col: str = "created_at") -> DataFrame:
    """Score request rows (11 measures + ``type``) and append them to the prediction log.

    ``model_path``: a saved model, for instance ``aliased_model(spark, model_dir)``."""
    append_table(spark, scored_rows(requests, model_path, id_col, ts_col), log_path, key=["id"])
    return spark.read.parquet(log_path)


def scored_rows(requests: DataFrame, model_path: str, id_col: str = "id", ts_col: str = "created_at") -> DataFrame:
    """Requests scored by a saved model, as rows of the prediction log; a missing feature column is an error."""
    req = normalize_columns(requests)
    enc = one_hot(req, "type", levels=TYPE_LEVELS, drop_source=False)
    enc = align_features(enc, FEATURES, strict=True, keep=[id_col, ts_col, "type"])
    model = load_model(model_path)
    out = scored(model.transform(enc.withColumn("quality", F.lit(0))), "quality")
    probs = F.create_map(F.lit("Not Good"), F.coalesce(F.lit(1.0) - F.col("p1"), F.lit(None).cast("double")),
                         F.lit("Good"), F.col("p1"))
    p_neg, p_pos = extract_probabilities(F.map_filter(probs, lambda k, v: v.isNotNull()))
    return out.select(F.col(id_col).cast("string").alias("id"), F.col(ts_col).alias("created_at"), *MEASURES,
                      F.col("type").alias("wine_type"), F.col("y_pred").cast("smallint").alias("predicted_quality"),
                      clean_label(class_label(F.col("y_pred"))).alias("quality_label"),
                      p_neg.alias("prob_not_good"), p_pos.alias("prob_good"),
                      F.lit(None).cast("double").alias("elapsed_ms"))
