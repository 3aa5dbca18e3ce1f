"""A Spark-native knowledge store and retrieval engine."""
