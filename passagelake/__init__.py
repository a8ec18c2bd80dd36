"""passagelake: a Spark-native engine for retrieval-oriented text analytics."""

__version__ = "0.1.0"
