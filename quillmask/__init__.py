"""A PySpark-native engine that finds, classifies and consistently replaces personal data."""
