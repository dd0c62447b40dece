"""The reference's own table layout, for users who run the library on that data.

Everything else in the library is generic over column names; these are the
names and bounds a scoring request of the original schema uses.
"""

from __future__ import annotations

# The scoring feature order (11 measurements, then the type flags).
SCORING_FEATURE_ORDER = [
    "fixed_acidity", "volatile_acidity", "citric_acid", "residual_sugar", "chlorides",
    "free_sulfur_dioxide", "total_sulfur_dioxide", "density", "ph", "sulphates", "alcohol",
    "type_red", "type_white",
]

# Input bounds (min, max) and defaults of the scoring form, per measurement.
INPUT_BOUNDS = {
    "fixed_acidity": (4.0, 16.0),
    "volatile_acidity": (0.08, 1.60),
    "citric_acid": (0.0, 1.70),
    "residual_sugar": (0.5, 16.0),
    "chlorides": (0.009, 0.65),
    "free_sulfur_dioxide": (1.0, 72.0),
    "total_sulfur_dioxide": (6.0, 289.0),
    "density": (0.9870, 1.0040),
    "ph": (2.70, 4.00),
    "sulphates": (0.20, 2.00),
    "alcohol": (8.0, 15.0),
}
INPUT_DEFAULTS = {
    "fixed_acidity": 7.4, "volatile_acidity": 0.50, "citric_acid": 0.30, "residual_sugar": 2.0,
    "chlorides": 0.08, "free_sulfur_dioxide": 15.0, "total_sulfur_dioxide": 46.0, "density": 0.9960,
    "ph": 3.30, "sulphates": 0.60, "alcohol": 10.0,
}

# The raw layout's column names (with blanks) and the normalised ones.
RAW_TO_NORMALISED = {
    "fixed acidity": "fixed_acidity", "volatile acidity": "volatile_acidity", "citric acid": "citric_acid",
    "residual sugar": "residual_sugar", "chlorides": "chlorides", "free sulfur dioxide": "free_sulfur_dioxide",
    "total sulfur dioxide": "total_sulfur_dioxide", "density": "density", "pH": "ph", "sulphates": "sulphates",
    "alcohol": "alcohol", "type": "type", "quality": "quality",
}
TYPE_LEVELS = ["red", "white"]
QUALITY_THRESHOLD = 7


def processed_projection():
    """X2 + X4 + X6 for the original table: either layout → the processed schema."""
    from pyspark.sql import functions as F

    from tabula.functions.scalars import binarize
    measures = [n for n in RAW_TO_NORMALISED.values() if n not in ("type", "quality")]
    aliases = {n: [n] + [r for r, m in RAW_TO_NORMALISED.items() if m == n and r != n] for n in measures}
    aliases["quality"] = ["quality"]
    return aliases, {"type": "string"}, lambda c: binarize(F.col(c), QUALITY_THRESHOLD)
