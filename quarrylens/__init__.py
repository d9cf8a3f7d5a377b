"""Spark-native analytics over sources, raw documents and enriched articles."""
