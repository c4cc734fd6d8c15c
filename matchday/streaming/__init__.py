"""Incremental ingest of bronze loads with Structured Streaming."""
