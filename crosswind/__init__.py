"""Spark-first cross-sectional analytics."""
