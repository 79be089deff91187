"""quern: a PySpark-native engine for building, tracking and querying text knowledge bases."""

__version__ = "0.1.0"
