"""Spark-native file catalog search, analytics and change feed."""
