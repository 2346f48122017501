"""A PySpark-native engine for a compact SQL dialect."""
