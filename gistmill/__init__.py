"""Spark-native, explainable context reduction."""
