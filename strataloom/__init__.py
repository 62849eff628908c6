"""Spark-first engine for versioned semantic graphs and the corpora around them."""

__version__ = "0.1.0"
