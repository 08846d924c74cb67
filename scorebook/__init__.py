"""PySpark-native analytics for two-sided contests and their event streams."""
