"""Spark-native analytics over seasonal broadcast catalogues."""
