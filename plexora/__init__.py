"""plexora: a Spark-native engine for semantic, relational and analytical queries over property graphs."""

__version__ = "0.1.0"
