"""Spark-native map analytics."""
