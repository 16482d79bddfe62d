"""Spark-native indexing and hybrid retrieval over text corpora."""
