"""Spark-native analytics over execution traces and irregular event data."""

__version__ = "0.1.0"
