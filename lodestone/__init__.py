"""Lodestone: a Spark-native analytics engine over Parquet tables."""

__version__ = "0.1.0"
