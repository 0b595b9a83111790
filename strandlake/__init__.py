"""Spark-native sequence, interval and alignment analytics."""

__version__ = "0.1.0"
