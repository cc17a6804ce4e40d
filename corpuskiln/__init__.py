"""Corpus-quality analytics as PySpark DataFrame operators."""
