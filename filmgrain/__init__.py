"""filmgrain: a PySpark-native engine for a film catalogue with reviews and review vectors."""
