"""Spark-native content-addressed catalog engine."""
