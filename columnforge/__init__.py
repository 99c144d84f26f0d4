"""A Spark-native engine for typed, nullable and nested columnar data."""
