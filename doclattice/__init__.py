"""A PySpark-native document-intelligence engine."""
