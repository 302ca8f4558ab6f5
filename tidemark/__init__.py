"""Spark-native engine for keyed, typed time-series tables."""
