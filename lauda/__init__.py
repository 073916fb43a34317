"""Lauda: a PySpark-native engine for document corpora and the records taken from them."""

__version__ = "0.1.0"
