"""Barloom: Spark-first analytics over one-minute price bars."""

__version__ = "0.1.0"
