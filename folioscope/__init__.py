"""Spark-native analytics for large text libraries."""
