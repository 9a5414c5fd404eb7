"""Corpus analytics as plain PySpark DataFrame operators."""
