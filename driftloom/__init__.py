"""Spark-native drift, impact and data-quality engine over code and document graphs."""

__version__ = "0.1.0"
