"""Spark-native analytics over text, documents, conversations and request logs."""
