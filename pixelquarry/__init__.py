"""Spark-native analytics over very large photo collections."""
