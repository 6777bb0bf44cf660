"""A Spark-native engine for bitemporal, evidence-backed knowledge graphs."""

__version__ = "0.1.0"
