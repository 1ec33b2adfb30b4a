"""Spark-native analytics on large, changing graphs."""
