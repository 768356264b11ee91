"""Spark-native knowledge-graph, retrieval and training-data analytics."""
