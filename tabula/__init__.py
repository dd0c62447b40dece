"""tabula: Spark-native tabular classification: preparation, profiling, rebalancing, training, evaluation, scoring."""

__version__ = "0.1.0"
