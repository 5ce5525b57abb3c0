"""Veinstone: a Spark-native engine for analytics over document collections."""
