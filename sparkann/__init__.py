"""A PySpark-native engine for vector-search and performance analytics."""
