"""A PySpark-native engine for integrating, resolving and analysing transaction records."""
