"""Spark-native indexed text and code search."""
