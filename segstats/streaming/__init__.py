"""Incremental ingest of run-result files (Structured Streaming)."""
