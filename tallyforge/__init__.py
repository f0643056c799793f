"""Spark-native analytics engine: transaction pipeline operators and corpus tools."""
