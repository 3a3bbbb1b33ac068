"""Structured Streaming versions of response ingestion and token accounting."""
