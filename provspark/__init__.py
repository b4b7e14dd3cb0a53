"""Spark-native code-provenance analytics."""
