"""A Spark-native engine for versioned key/value data."""
