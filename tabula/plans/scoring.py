"""Scoring, prediction log, history and monitoring queries (X14-X18, K7, J5, W1, W2, ST1, ST2, X27).

Fixture: every ``events`` row is one scoring request.  ``value / 500`` plays the
model's probability of the good class; the probability map is keyed the way
the front end does it, with alias-only and empty maps on some event types so
the complement and (0, 0) rules are exercised.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabula.functions.labels import class_label, confidence, extract_probabilities
from tabula.functions.scalars import clean_label, percent_text, safe_double
from tabula.operators.models import classifier, load_model, save_model, scored
from tabula.operators.profile import sig
from tabula.plans import sqltext as S
from tabula.plans.registry import register
from tabula.session import cut_lineage, scratch_path
from tabula.sources.readers import read_table
from tabula.sources.sinks import BUCKET, append_keyed, conform, prediction_log_schema
from tabula.streaming.monitor import run_monitor_stream
from tabula.streaming.scoring import read_log, run_model_stream, written_in_turn

PROB_SCALE = 500.0
EVENT_COLS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


def prob_map(event_type: Column, p: Column) -> Column:
    full = F.create_map(F.lit("🔴 Not Good"), F.lit(1.0) - p, F.lit("🟢 Good"), p)
    alias_only = F.create_map(F.lit("Bom"), p)
    empty = F.create_map().cast("map<string,double>")
    return F.when(event_type == "error", alias_only).when(event_type == "signup", empty).otherwise(full)


def score_requests(df: DataFrame) -> DataFrame:
    """Scoring requests → prediction-log rows (batch or stream: only row-wise expressions)."""
    p = (F.col("value") / F.lit(PROB_SCALE)).alias("p")
    scored = df.select("*", p).withColumn("predicted_quality", F.when(F.col("p") >= 0.5, 1).otherwise(0))
    scored = scored.withColumn("probs", prob_map(F.col("event_type"), F.col("p")))
    p_neg, p_pos = extract_probabilities(F.col("probs"))
    conf = confidence(F.array(p_neg, p_pos), F.col("predicted_quality"))
    return scored.select(
        F.col("event_id").cast("string").alias("id"), F.col("ts").alias("created_at"), "value",
        F.col("event_type").alias("wine_type"), F.col("predicted_quality").cast("smallint").alias("predicted_quality"),
        clean_label(class_label(F.col("predicted_quality"))).alias("quality_label"),
        p_neg.alias("prob_not_good"), p_pos.alias("prob_good"), conf.alias("confidence"),
        percent_text(conf).alias("confidence_text"), F.lit(None).cast("double").alias("elapsed_ms"))


SCORED_SQL = f"""
    WITH s AS (SELECT *, value / {S.dbl(PROB_SCALE)} AS p FROM events),
    t AS (SELECT *, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS pq,
                 CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'signup' THEN NULL ELSE 1.0 - p END AS neg0,
                 CASE WHEN event_type = 'signup' THEN NULL ELSE p END AS pos0 FROM s),
    u AS (SELECT *, CASE WHEN neg0 IS NULL AND pos0 IS NULL THEN 0.0 ELSE coalesce(neg0, 1.0 - pos0) END AS pn,
                    CASE WHEN neg0 IS NULL AND pos0 IS NULL THEN 0.0 ELSE coalesce(pos0, 1.0 - neg0) END AS pp FROM t),
    scored AS (
      SELECT CAST(event_id AS VARCHAR) AS id, ts AS created_at, value, event_type AS wine_type,
             CAST(pq AS SMALLINT) AS predicted_quality,
             CASE WHEN pq = 1 THEN 'Good' ELSE 'Not Good' END AS quality_label,
             pn AS prob_not_good, pp AS prob_good, CASE WHEN pq = 1 THEN pp ELSE pn END AS confidence,
             printf('%.1f%%', {S.rnd('(CASE WHEN pq = 1 THEN pp ELSE pn END) * 100.0', 1)}) AS confidence_text,
             CAST(NULL AS DOUBLE) AS elapsed_ms
      FROM u)
"""


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_requests(read_table(spark, sf_dir, "events", EVENT_COLS))


@register("scored_requests", SCORED_SQL + "SELECT * FROM scored")
def q_scored_requests(spark, sf_dir):
    return scored_events(spark, sf_dir)


@register("safe_double_parse", f"""
    SELECT event_id, coalesce(TRY_CAST(trim(json_extract_string(props, '$.k')) AS DOUBLE), 0.0) AS k,
           coalesce(TRY_CAST(trim(json_extract_string(props, '$.missing')) AS DOUBLE), {S.dbl(-1.0)}) AS missing,
           coalesce(TRY_CAST(trim(event_type) AS DOUBLE), 0.0) AS not_a_number
    FROM events
""")
def q_safe_double(spark, sf_dir):
    e = read_table(spark, sf_dir, "events", ["event_id", "event_type", "props"])
    return e.select("event_id", safe_double(F.get_json_object("props", "$.k")).alias("k"),
                    safe_double(F.get_json_object("props", "$.missing"), -1.0).alias("missing"),
                    safe_double(F.col("event_type")).alias("not_a_number"))


LOG_FEATURES = ["value"]


@register("prediction_log_append", SCORED_SQL + f"""
    SELECT id, created_at, value, wine_type, predicted_quality, quality_label, prob_not_good, prob_good, elapsed_ms
    FROM scored
""")
def q_prediction_log_append(spark, sf_dir):
    """K7 + J5: the same batch appended twice lands once (keyed on ``id``)."""
    schema = prediction_log_schema(LOG_FEATURES)
    rows = conform(scored_events(spark, sf_dir), schema)
    path = scratch_path(spark, "prediction_log")
    append_keyed(spark, rows, path, key=["id"])
    append_keyed(spark, rows, path, key=["id"])
    return spark.read.parquet(path).drop(BUCKET)


HISTORY_N = 100


@register("latest_predictions", SCORED_SQL + f"""
    SELECT id, created_at, predicted_quality, quality_label, confidence_text FROM scored
    ORDER BY created_at DESC, id LIMIT {HISTORY_N}
""")
def q_latest_predictions(spark, sf_dir):
    """The newest predictions (a top-k report: the limit is the feature)."""
    from tabula.operators.history import latest
    return latest(scored_events(spark, sf_dir), "created_at", "id", HISTORY_N).select(
        "id", "created_at", "predicted_quality", "quality_label", "confidence_text")


@register("history_tail", SCORED_SQL + """
    SELECT id, created_at, quality_label FROM (
      SELECT * FROM scored ORDER BY created_at DESC, id DESC LIMIT 20)
""")
def q_history_tail(spark, sf_dir):
    """The last 20 entries of the history, shown oldest first."""
    from tabula.operators.history import tail
    return tail(scored_events(spark, sf_dir), "created_at", "id", 20).select("id", "created_at", "quality_label")


WINDOW = "1 hour"


@register("rolling_prediction_counts", SCORED_SQL + """
    SELECT time_bucket(INTERVAL 1 HOUR, created_at) AS window_start,
           time_bucket(INTERVAL 1 HOUR, created_at) + INTERVAL 1 HOUR AS window_end,
           predicted_quality, count(*) AS n_predictions,
           CAST(printf('%.9e', avg(confidence)) AS DOUBLE) AS mean_confidence
    FROM scored GROUP BY ALL
""")
def q_rolling_counts(spark, sf_dir):
    """ST2 (batch form): predictions and mean confidence per hour and class."""
    from tabula.streaming.monitor import rolling_counts
    out = rolling_counts(scored_events(spark, sf_dir), WINDOW)
    return out.withColumn("mean_confidence", sig(F.col("mean_confidence")))


# ── ST1: the model of the scoring stream, found again in SQL by Newton steps ──
#: Fixed rule of the training label: the value plus a spread of 60 that the id decides, against 50.
LABEL = "CASE WHEN value + ((event_id * 7919) % 100) * 0.6 - 30 > 50 THEN 1.0 ELSE 0.0 END"
STEPS = 14


def _stream_sql() -> str:
    ctes = [f"""e AS MATERIALIZED (SELECT event_id, ts, event_type, value, value / 100.0::DOUBLE AS x1, CAST(user_id % 3 AS DOUBLE) AS x2,
        CAST({LABEL} AS DOUBLE) AS y FROM events), s0 AS (SELECT 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2)"""]
    for k in range(1, STEPS + 1):
        ctes.append(f"""
    p{k} AS (SELECT x1, x2, y, s.*, 1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))) AS p FROM e, s{k - 1} s),
    h{k} AS MATERIALIZED (SELECT any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2, sum(p - y) AS g0,
        sum((p - y) * x1) + any_value(b1) AS g1, sum((p - y) * x2) + any_value(b2) AS g2, sum(p * (1 - p)) AS a, sum(p * (1 - p) * x1) AS b,
        sum(p * (1 - p) * x2) AS c, sum(p * (1 - p) * x1 * x1) + 1 AS d, sum(p * (1 - p) * x1 * x2) AS e, sum(p * (1 - p) * x2 * x2) + 1 AS f FROM p{k}),
    d{k} AS (SELECT *, a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c) AS det FROM h{k}),
    s{k} AS MATERIALIZED (SELECT b0 - (g0 * (d * f - e * e) - b * (g1 * f - e * g2) + c * (g1 * e - d * g2)) / det AS b0,
        b1 - (a * (g1 * f - g2 * e) - g0 * (b * f - e * c) + c * (b * g2 - g1 * c)) / det AS b1,
        b2 - (a * (d * g2 - e * g1) - b * (b * g2 - c * g1) + g0 * (b * e - d * c)) / det AS b2 FROM d{k})""")
    p = "1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2)))"
    return f"""WITH {", ".join(ctes)}, q AS (SELECT e.*, {S.rnd(p, 4)} AS p, {p} > 0.5 AS good FROM e, s{STEPS})
    SELECT CAST(event_id AS VARCHAR) AS id, ts AS created_at, value, event_type AS wine_type, CAST(good AS SMALLINT) AS predicted_quality,
        CASE WHEN good THEN 'Good' ELSE 'Not Good' END AS quality_label, {S.rnd('1.0::DOUBLE - p', 4)} AS prob_not_good, p AS prob_good,
        CAST(NULL AS DOUBLE) AS elapsed_ms FROM q"""


def stream_features(df: DataFrame) -> DataFrame:
    return df.withColumn("x1", F.col("value") / 100.0).withColumn("x2", (F.col("user_id") % 3).cast("double"))


def fit_stream_model(spark: SparkSession, sf_dir: str) -> str:
    """The scoring stream's model (C = 1), fitted on the events and saved; returns its path."""
    e = stream_features(read_table(spark, sf_dir, "events", EVENT_COLS)).withColumn("label", F.expr(LABEL).cast("double"))
    e = cut_lineage(e.select("x1", "x2", "label"))
    learner = classifier("logistic_regression", 2, e.count())[0].setTol(1e-12)
    model = Pipeline(stages=[VectorAssembler(inputCols=["x1", "x2"], outputCol="features"), learner]).fit(e)
    return save_model(model, scratch_path(spark, "stream_model"))


def model_scorer(model: PipelineModel):
    """Requests → prediction-log rows of a saved model."""
    def score(batch: DataFrame) -> DataFrame:
        s = scored(model.transform(stream_features(batch).withColumn("label", F.lit(0))))
        p = F.round("p1", 4)
        return s.select(F.col("event_id").cast("string").alias("id"), F.col("ts").alias("created_at"), "value", F.col("event_type").alias("wine_type"),
                        F.col("y_pred").cast("smallint").alias("predicted_quality"), clean_label(class_label(F.col("y_pred"))).alias("quality_label"),
                        F.round(1.0 - p, 4).alias("prob_not_good"), p.alias("prob_good"))
    return score


def time_parts(events: DataFrame, n: int) -> list[DataFrame]:
    """``events`` cut into ``n`` equal spans of time."""
    lo, hi = events.agg(F.min("ts"), F.max("ts")).first()
    if lo is None:
        return [events]
    cuts = [lo + (hi - lo) * k // n for k in range(1, n)]
    edge = [None, *cuts, None]
    return [events.where((F.lit(True) if a is None else F.col("ts") >= F.lit(a)) & (F.lit(True) if b is None else F.col("ts") < F.lit(b)))
            for a, b in zip(edge, edge[1:])]


@register("stream_scoring", _stream_sql())
def q_stream_scoring(spark, sf_dir):
    """ST1: request files in several triggers, every ninth request delivered twice → saved model → log by epoch; returns the log."""
    events = read_table(spark, sf_dir, "events", EVENT_COLS)
    source = written_in_turn([*time_parts(events, 3), events.where(F.col("event_id") % 9 == 0)])
    path, checkpoint = scratch_path(spark, "stream_prediction_log"), scratch_path(spark, "stream_checkpoint")
    model = fit_stream_model(spark, sf_dir)
    run_model_stream(spark, source, events.schema, model, path, checkpoint, LOG_FEATURES, model_scorer(load_model(model)), "event_id",
                     files_per_trigger=1)
    return read_log(spark, path, prediction_log_schema(LOG_FEATURES))


DELAY_MINUTES = 10
_LATE = "event_id % 10 = 3"


@register("stream_monitor", SCORED_SQL + f""",
    m AS (SELECT *, {_LATE} AS late, time_bucket(INTERVAL 1 HOUR, ts) AS w FROM (SELECT s.*, e.event_id, e.ts FROM scored s JOIN events e ON s.id = CAST(e.event_id AS VARCHAR))),
    cut AS (SELECT make_timestamp(epoch_us(min(ts)) + (epoch_us(max(ts)) - epoch_us(min(ts))) * 3 // 4) AS c FROM m WHERE NOT late),
    seen AS (SELECT max(ts) FILTER (NOT late AND ts < c) - INTERVAL {DELAY_MINUTES} MINUTE AS before_late, max(ts) - INTERVAL {DELAY_MINUTES} MINUTE AS at_end
        FROM m, cut)
    SELECT w AS window_start, w + INTERVAL 1 HOUR AS window_end, predicted_quality, count(*) AS n_predictions,
        CAST(printf('%.9e', avg(confidence)) AS DOUBLE) AS mean_confidence
    FROM m, seen WHERE w + INTERVAL 1 HOUR <= at_end AND (NOT late OR w + INTERVAL 1 HOUR > before_late) GROUP BY w, predicted_quality
""")
def q_stream_monitor(spark, sf_dir):
    """ST2: files in five triggers over two runs of the stream; a tenth of the rows comes last.

    A trigger drops what the watermark of the trigger before it calls late: here that of the first three quarters."""
    events = read_table(spark, sf_dir, "events", EVENT_COLS)
    parts = time_parts(events.where(f"NOT ({_LATE})"), 4)
    folder = written_in_turn(parts[:2])
    out, checkpoint = scratch_path(spark, "monitor"), scratch_path(spark, "monitor_checkpoint")

    def run() -> None:
        rows = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        run_monitor_stream(score_requests(rows), out, checkpoint, WINDOW, delay=f"{DELAY_MINUTES} minutes")

    run()
    written_in_turn([*parts[2:], events.where(_LATE)], folder)
    run()  # a new query: state and watermark come from the checkpoint
    return spark.read.parquet(out).withColumn("mean_confidence", sig(F.col("mean_confidence")))


# ── X27: drift ──────────────────────────────────────────────────────────────
PSI_BINS = 10


@register("drift_psi", f"""
    WITH ref AS (SELECT c_acctbal AS x FROM customer WHERE c_acctbal IS NOT NULL),
    cur AS (SELECT s_acctbal AS x FROM supplier WHERE s_acctbal IS NOT NULL),
    rng AS (SELECT min(x) AS lo, (max(x) - min(x)) / {S.dbl(PSI_BINS)} AS w FROM ref),
    rb AS (SELECT CAST(CASE WHEN w > 0 THEN greatest(least(floor((x - lo) / w), {PSI_BINS - 1}), 0) ELSE 0 END AS INTEGER) AS bin
           FROM ref, rng),
    cb AS (SELECT CAST(CASE WHEN w > 0 THEN greatest(least(floor((x - lo) / w), {PSI_BINS - 1}), 0) ELSE 0 END AS INTEGER) AS bin
           FROM cur, rng),
    bins AS (SELECT CAST(unnest(range(0, {PSI_BINS})) AS INTEGER) AS bin),
    re AS (SELECT bin, count(*) AS n FROM rb GROUP BY bin), ce AS (SELECT bin, count(*) AS n FROM cb GROUP BY bin),
    sh AS (SELECT bins.bin,
                  greatest(CAST(coalesce(re.n, 0) AS DOUBLE) / CAST((SELECT count(*) FROM rb) AS DOUBLE), {S.dbl(1e-6)}) AS e,
                  greatest(CAST(coalesce(ce.n, 0) AS DOUBLE) / CAST((SELECT count(*) FROM cb) AS DOUBLE), {S.dbl(1e-6)}) AS a
           FROM bins LEFT JOIN re USING (bin) LEFT JOIN ce USING (bin))
    SELECT bin, e AS expected_share, a AS actual_share, CAST(printf('%.9e', (a - e) * ln(a / e)) AS DOUBLE) AS psi_term
    FROM sh
""")
def q_drift_psi(spark, sf_dir):
    from tabula.operators.drift import psi_table
    ref = read_table(spark, sf_dir, "customer", ["c_acctbal"]).withColumnRenamed("c_acctbal", "x")
    cur = read_table(spark, sf_dir, "supplier", ["s_acctbal"]).withColumnRenamed("s_acctbal", "x")
    out = psi_table(ref, cur, "x", PSI_BINS)
    return out.select("bin", "expected_share", "actual_share", sig(F.col("psi_term")).alias("psi_term"))
