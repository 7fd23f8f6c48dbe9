"""Spark-native analytics over shelf observations."""
