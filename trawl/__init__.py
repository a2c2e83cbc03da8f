"""A PySpark-native document search engine."""
