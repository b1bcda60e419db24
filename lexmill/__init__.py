"""Spark-native lexical analytics: typed sources, expression libraries, operators and query plans."""

__version__ = "0.1.0"
