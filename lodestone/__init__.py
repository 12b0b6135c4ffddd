"""Spark-native retrieval, ingestion and document analytics."""
