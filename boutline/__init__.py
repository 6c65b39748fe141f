"""Spark-native analytics for head-to-head contests."""
