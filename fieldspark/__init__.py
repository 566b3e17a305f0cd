"""Spark-native low-rank spatial and spatio-temporal analytics."""

__version__ = "0.1.0"
