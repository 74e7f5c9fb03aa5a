"""Spark-native document queries, period statistics and model-drift analysis."""
