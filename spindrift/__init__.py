"""Spark-native code and text retrieval analytics."""
