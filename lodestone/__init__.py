"""Spark-native retrieval and analytics over source code and text."""
