"""Spark-native analytics of biological sequence files."""
