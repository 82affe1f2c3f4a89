"""A Spark-native engine for the analytics of generated-artifact runs."""
