"""Orrery: a Spark-native analytics engine for collections of embedding vectors."""

__version__ = "0.1.0"
