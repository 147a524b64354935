"""Spark-native analytics for application-layer traffic: DataFrame, SQL and Structured Streaming only."""
