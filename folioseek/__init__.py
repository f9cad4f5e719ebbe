"""Spark-native document search and document analytics."""
