"""Spark-native entity resolution and corpus processing."""
