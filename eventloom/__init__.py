"""Spark-native media event analytics: listings in, events, names and file-operation plans out."""

__version__ = "0.1.0"
