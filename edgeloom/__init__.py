"""A Spark-native engine for spatial neighbor graphs."""
