"""Spark-native analytics for electricity-market data."""
