"""Structured Streaming forms of scoring and ingest."""
