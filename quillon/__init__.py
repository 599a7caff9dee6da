"""Spark-native ontology and knowledge-graph analytics."""

__version__ = "0.1.0"
