"""Spark-native engine for knowledge hypergraphs, hybrid retrieval, graph evolution and trajectory analytics."""
