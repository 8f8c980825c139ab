"""A PySpark-native vector-similarity analytics engine."""

__version__ = "0.1.0"
