"""Spark-native analytics for website crawls: every operator takes and returns DataFrames."""

__version__ = "0.1.0"
