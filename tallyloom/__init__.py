"""Spark-first automatic statistics and text profiling."""

__version__ = "0.1.0"
