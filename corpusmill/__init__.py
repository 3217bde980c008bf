"""corpusmill: a PySpark-native engine for building, measuring and cleaning retrieval corpora."""

__version__ = "0.1.0"
