"""Spark-native evidence retrieval over archived search results, pages and conversations."""
