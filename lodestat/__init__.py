"""Tabular profiling, statistics, scoring and drift as lazy Spark DataFrame operators."""

__version__ = "0.1.0"
