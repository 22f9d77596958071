"""Spark-native engine for code knowledge graphs and training-data checks."""
