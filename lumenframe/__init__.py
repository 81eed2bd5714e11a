"""Spark-native analytics over streams of model observations."""
