"""Spark-native hybrid retrieval, knowledge lifecycle and service-desk analytics."""
