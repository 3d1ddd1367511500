"""A PySpark-native engine for statistical and forecasting models on large tables."""
