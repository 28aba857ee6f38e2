"""Spark-native report analytics, case lifecycle and corpus preparation."""
