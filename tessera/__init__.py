"""Tessera: Spark-first retrieval-bank, mask-analytics and corpus operators."""

__version__ = "0.1.0"
