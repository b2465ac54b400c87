"""Spark-native evidence retrieval, its evaluation, and corpus preparation."""
