"""Spark-native corpus verification and analytics."""
