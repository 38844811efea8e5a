"""Typed-token analytics over semi-structured text, expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
