"""Label, probability and run-name helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabula.functions.scalars import as_col, clean_label

# Display labels of the two classes and the probability-map key aliases.
CLASS_LABELS = {0: "🔴 Not Good", 1: "🟢 Good"}
NEGATIVE_KEYS = ["Not Good", "Ruim"]
POSITIVE_KEYS = ["Good", "Bom"]
# Metric names tried, in order, for a run's F1.
F1_ALIASES = ["val_f1", "val_binary_f1_weighted_tuned", "val_binary_f1_weighted"]
# Registry prefix and alias suffix stripped from champion names.
REGISTRY_PREFIX = "wine_"
ALIAS_SUFFIX = "@champion"


def class_label(c, labels: dict[int, str] | None = None) -> Column:
    """Display label for a class index, falling back to the number as text."""
    labels = CLASS_LABELS if labels is None else labels
    pairs = []
    for k, v in labels.items():
        pairs += [F.lit(int(k)), F.lit(v)]
    c = as_col(c)
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c.cast("int")), c.cast("string"))


def _first_present(cleaned: Column, keys) -> Column:
    """Value of the first of ``keys`` that occurs; of equal cleaned keys the last entry wins."""
    expr = F.lit(None).cast("double")
    for key in reversed(list(keys)):
        own = _own(cleaned, key)
        expr = F.when(F.size(own) > 0, F.element_at(own, -1)["value"]).otherwise(expr)
    return expr


def _own(cleaned: Column, key: str) -> Column:
    return F.filter(cleaned, lambda e: e["key"] == F.lit(key))


def extract_probabilities(prob_map) -> tuple[Column, Column]:
    """(prob_not_good, prob_good) from a ``map<string, any>``.

    Keys are cleaned of icon prefixes; values parsed as double with 0 default.
    One side missing is the complement of the other; both missing gives (0, 0).
    """
    m = as_col(prob_map)
    cleaned = F.transform(
        F.map_entries(m),
        lambda e: F.struct(clean_label(e["key"]).alias("key"),
                           F.coalesce(e["value"].cast("string").try_cast("double"),
                                      F.lit(0.0)).alias("value")))
    neg = _first_present(cleaned, NEGATIVE_KEYS)
    pos = _first_present(cleaned, POSITIVE_KEYS)
    both_missing = neg.isNull() & pos.isNull()
    p_neg = F.when(both_missing, F.lit(0.0)).otherwise(F.coalesce(neg, F.lit(1.0) - pos))
    p_pos = F.when(both_missing, F.lit(0.0)).otherwise(F.coalesce(pos, F.lit(1.0) - neg))
    return p_neg, p_pos


def confidence(prob_array, predicted, classes_array=None) -> Column:
    """Probability of the predicted class; index 0 when the class is not listed."""
    probs = as_col(prob_array)
    pred = as_col(predicted)
    if classes_array is None:
        idx = pred.cast("int")
    else:
        pos = F.array_position(as_col(classes_array), pred)
        idx = F.when(pos > 0, pos - 1).otherwise(F.lit(0))
    return F.try_element_at(probs, (idx + 1).cast("int"))


def split_run_name(run) -> tuple[Column, Column]:
    """``'SMOTE_random_forest'`` → (``'SMOTE'``, ``'random_forest'``); no ``_`` → (run, 'Unknown')."""
    r = as_col(run)
    parts = F.split(r, "_", 2)
    strategy = F.when(F.length(r) == 0, F.lit("Unknown")).otherwise(parts[0])
    algo = F.when(F.size(parts) > 1, parts[1]).otherwise(F.lit("Unknown"))
    return strategy, algo


def strip_registry_name(name) -> Column:
    """``'wine_Tomek_knn@champion'`` → ``'Tomek_knn'``."""
    s = F.trim(F.replace(as_col(name), F.lit(ALIAS_SUFFIX), F.lit("")))
    return F.when(F.startswith(s, F.lit(REGISTRY_PREFIX)),
                  F.substring(s, len(REGISTRY_PREFIX) + 1, 1 << 30)).otherwise(s)


def best_f1(metrics_map, aliases: list[str] | None = None) -> Column:
    """Row-wise max over the F1 aliases of a ``map<string,double>``, missing → 0."""
    m = as_col(metrics_map)
    vals = [F.coalesce(F.try_element_at(m, F.lit(a)), F.lit(0.0)) for a in (aliases or F1_ALIASES)]
    return F.greatest(*vals) if len(vals) > 1 else vals[0]
