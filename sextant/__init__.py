"""Sextant: semantic retrieval and text processing as PySpark DataFrame operators."""

__version__ = "0.1.0"
