"""Spark-native analytics for mobile genetic elements in sequence data."""
