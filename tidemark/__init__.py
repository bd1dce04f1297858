"""Tidemark: a PySpark-native engine for time-series measurement."""
