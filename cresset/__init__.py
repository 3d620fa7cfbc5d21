"""Spark-native operators for auditing generated titles against an item catalog."""

__version__ = "0.1.0"
