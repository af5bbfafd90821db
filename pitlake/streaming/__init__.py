"""Structured Streaming versions of the ingestion steps."""
