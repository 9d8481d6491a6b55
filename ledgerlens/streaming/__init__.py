"""Incremental refresh on Structured Streaming (extension E1)."""
