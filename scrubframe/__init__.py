"""Spark-native engine for finding, reviewing and removing text burned into image archives."""

__version__ = "0.1.0"
