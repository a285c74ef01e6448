"""Batch retrieval, question answering and text-corpus processing on PySpark."""

__version__ = "0.1.0"
