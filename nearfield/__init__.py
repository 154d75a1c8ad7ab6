"""Spark-first vector search and analytics."""
