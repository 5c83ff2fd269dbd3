"""Data-quality analytics as lazy, distributed Spark DataFrame operators."""

__version__ = "0.1.0"
