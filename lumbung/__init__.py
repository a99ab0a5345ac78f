"""Spark-native analytics engine for messy review exports."""
