"""Composed plans: retrieval, ingestion, endpoints and the query catalogue."""
