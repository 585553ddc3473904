"""Spark-native analytics over structured document collections."""
