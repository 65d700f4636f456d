"""A Spark-native engine for vector geodata."""
