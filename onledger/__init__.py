"""Spark-native analytics for on-chain trading data."""
