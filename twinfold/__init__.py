"""Spark-native record deduplication and entity resolution."""
