"""A PySpark-native engine for trace sampling and span storage."""
